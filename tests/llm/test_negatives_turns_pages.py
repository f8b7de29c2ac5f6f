"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from llm_data import TURNS, prose

from revlens.llm import hard_negatives as HN
from revlens.llm import turn_repair as TR
from revlens.llm import wrapper as W
from revlens.llm.queries import QUERIES


# --- 11 ---------------------------------------------------------------------------------
def brute_negatives(rows):
    pts = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        pts.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    key = lambda h: (-h[0], h[1] is None, h[1] or 0)
    out = []
    for a, (vec_id, v, label) in enumerate(pts):
        if vec_id is None or vec_id % 100:
            continue
        hits = [(sum(x * y for x, y in zip(v, w, strict=False)), i, other) for b, (i, w, other) in enumerate(pts) if b != a]
        for score, pos, _ in sorted((h for h in hits if h[2] == label), key=key)[:5]:
            window = [h for h in hits if h[2] != label and 80 * score <= 100 * h[0] <= 100 * score]
            out += [(vec_id, pos, n + 1, i, score, s) for n, (s, i, _) in enumerate(sorted(window, key=key)[:5])]
    return sorted(out, key=repr)


def mined(spark, rows, cfg=None):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, row int").repartition(3)
    return sorted(map(tuple, HN.hard_negatives(df, cfg or HN.Config()).collect()), key=repr)


def test_tiles_keep_every_row():
    keys = np.random.default_rng(1).integers(-9, 9, (1000, 5))
    runs = HN.tiles(keys, 16)
    assert sorted(np.concatenate(runs).tolist()) == list(range(1000)) and max(map(len, runs)) <= 16


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_search_equals_full_scan(same, exact):
    r = np.random.default_rng(3)
    v, labels = r.integers(-40, 40, (600, 6)), r.integers(0, 3, 600)
    v[100:300] = v[100]  # ties
    ids, rows = r.permutation(600), np.arange(600)
    tree = HN.Tree.pack(ids, np.zeros(600, bool), rows, labels, v, HN.Config(leaf=8, fan=3))
    asked = r.choice(600, 40, replace=False)
    least, most = (np.full(40, HN.NONE), np.full(40, HN.EVER)) if same else (r.integers(-500, 500, 40), r.integers(500, 4000, 40))
    q = HN.Queries(v[asked], labels[asked], rows[asked], least, most, exact)
    for n, got in enumerate(HN.search(tree, q, 5, same)):
        a = asked[n]
        ok = [i for i in range(600) if (i != a if same else True) and (labels[i] == labels[a]) == same and least[n] <= v[a] @ v[i] <= most[n]]
        want = sorted((-int(v[a] @ v[i]), int(ids[i])) for i in ok)[:5]
        assert [g[:2] for g in got] == want


def test_boxes_are_pruned():
    r = np.random.default_rng(4)
    v = np.concatenate([r.integers(-3, 3, (400, 4)) + c for c in ([90, 0, 0, 0], [0, 90, 0, 0], [-90, 0, 0, 0])])
    tree = HN.Tree.pack(np.arange(1200), np.zeros(1200, bool), np.arange(1200), np.zeros(1200, int), v, HN.Config(leaf=16))
    seen = []
    tree_bounds = tree.bounds
    tree.bounds = lambda q, nodes: seen.append(len(nodes)) or tree_bounds(q, nodes)
    q = HN.Queries(v[:1], np.zeros(1, int), np.zeros(1, int), np.array([HN.NONE]), np.array([HN.EVER]), True)
    HN.search(tree, q, 5, True)
    assert sum(seen) < len(tree.first) / 2


def test_negatives_with_ties_nulls_and_many_tiles(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-0.5, 0.5) for _ in range(6)], r.choice([0, 1, 1, 3])) for i in range(900)]
    rows += [(i, [0.25] * 6, i % 3) for i in range(1000, 1200)]  # equal vectors
    rows += [rows[100], rows[100], (None, [0.3] * 6, 1), (2000, None, 1), (2100, [0.1], 2), (2200, [], 1), (2300, [float("nan")] * 6, 1), (2400, [0.1] * 6, None)]
    want = brute_negatives(rows)
    assert mined(spark, rows, HN.Config(part=50, leaf=8, fan=3, block=4, group=3)) == want
    assert mined(spark, rows) == want


def test_negatives_of_large_components_and_none(spark):
    rows = [(i, [float(i * 37 % 101) * 600, float(-i)], i % 2) for i in range(0, 300, 4)] + [(1, [1e9, 1.0], 0)]
    assert mined(spark, rows, HN.Config(part=20)) == brute_negatives(rows[:-1])  # a component beyond the limit takes no part
    assert mined(spark, []) == []
    assert mined(spark, [(100, [0.5], 1)]) == []


# --- 12 ---------------------------------------------------------------------------------
def next_state(q, initial):
    return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((q, initial))


def cheapest(rows):
    """(cost, audit, text) by trying all edits; rows: (role, text, must delete, truncated)."""
    best = {}
    todo = [(0, "", 0, "0", [])]
    ends = []
    while todo:
        todo.sort(key=lambda x: (x[0], x[1]))
        cost, audit, i, q, out = todo.pop(0)
        if (i, q) in best and best[i, q] < (cost, audit):
            continue
        best[i, q] = cost, audit
        if ends and cost > ends[0][0]:
            break
        if i == len(rows) and q in "0a":
            ends.append((cost, audit, out))
        own = "a" if q == "u" else "u"
        name = {"u": "user", "a": "assistant"}[own]
        todo.append((cost + 5, audit + "I", i, own, [*out, f"{name}:"]))
        if i < len(rows):
            role, text, must, cut = rows[i]
            todo.append((cost + 2, audit + "D", i + 1, q, out))
            if not must:
                extra = 5 * cut
                if next_state(q, role[:1]):
                    todo.append((cost + extra, audit + "K", i + 1, next_state(q, role[:1]), [*out, f"{role}:{text}"]))
                todo.append((cost + extra + 1, audit + "R", i + 1, own, [*out, f"{name}:{text}"]))
    return min(ends, key=lambda e: e[:2])


def brute_repair(rows):
    known = {}
    for conv, turn, role, text, *_ in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        mine = known.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in known.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(mine)]
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, text = cheapest(marked)
        out.append((conv, gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(spark, rows):
    return spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string").repartition(4)


def test_repair_equals_trying_all_edits(spark):
    assert sorted(map(tuple, TR.repaired(turns(spark, TURNS)).collect()), key=repr) == brute_repair(TURNS)


def test_blocks_equal_single_steps():
    t, r = TR.tables(), random.Random(1)
    for n in (0, 1, 3, 4, 5, 17, 64):
        s = [r.randrange(TR.SYMBOLS) for _ in range(n)]
        costs, total, v = list(t.END), 0, 0
        for c in reversed(s):
            costs = list(TR.before(c, costs))
            total += t.one_cost[v][c]
            v = t.one_step[v][c]
        behind, front, cost = t.backward(np.array(s, np.uint8), 0)
        assert (front, cost, len(behind)) == (v, total, n // TR.BLOCK)
        assert [c + cost for c in t.vectors[front]] == costs
        to, adds = t.transition(np.array(s, np.uint8))
        assert (to[0], adds[0]) == (front, cost)


def test_large_conversation_in_segments(spark, monkeypatch):
    r = random.Random(9)
    rows = [(7, i // 2, r.choice(["user", "assistant", "system", "x"]), r.choice(["A.", "B", f"text {i}.", f"cut {i}"])) for i in range(300)]
    rows += [(8, 1, "user", "Hi."), (8, 2, "assistant", "Yes.")]
    whole = sorted(map(tuple, TR.repaired(turns(spark, rows)).collect()), key=repr)
    parts = list(TR._read_part(part_rows(spark, rows)))
    assert any(p.get("segment") is not None for p in parts)
    assert whole == brute_repair(rows)


def part_rows(spark, rows):
    s = TR.symbols(TR.damaged(turns(spark, rows))).orderBy("conv_id", "turn", "role", "text").collect()
    return iter([{**r.asDict(), "role": (r.role or "").encode(), "text": (r.text or "").encode(), "part": 0} for r in s])


def test_segments_join_to_the_same_result(spark):
    """All segments of a task through both streams, cut every 7 rows."""
    r = random.Random(10)
    rows = [(c, i, r.choice(["user", "assistant", "system"]), r.choice(["A.", f"t {i}.", f"cut {i}"])) for c in (1, 2, 3) for i in range(60)]
    old, TR.SEGMENT = TR.SEGMENT, 7
    try:
        parts = list(TR._read_part(part_rows(spark, rows)))
    finally:
        TR.SEGMENT = old
    assert all("segment" in p for p in parts) and len(parts) > 20
    order = sorted(parts, key=lambda p: (p["conv_id"], -p["segment"]))
    back = sorted(TR._backward(iter(order)), key=lambda p: (p["conv_id"], p["segment"]))
    got = [tuple(x.values()) for x in TR._forward({"cost": None, **p} for p in back)]
    assert sorted(got, key=repr) == brute_repair(rows)


def test_empty_and_dropped_conversations(spark):
    assert TR.repaired(turns(spark, [])).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = TR.repaired(turns(spark, [(gone, 0, "user", "Gone.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- 13 ---------------------------------------------------------------------------------
def site(i, body, side="About us", extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x='<p>no</p>';</script></head><body><header>Site head</header>"
        f"<nav><ul><li><a href='/'>Home {i}</a><li>News</ul></nav><div class='ad'>Buy {i}</div><div id=c1><div class=story>{body}</div>"
        f"<div class=c2>{side}</div></div><aside>Aside {i}</aside><div class='comments'><p>Reader {i} says no</div>{extra}<form>Search <input></form><footer>&copy; {i}</footer></body></html>"
    )


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    return {r.page_id: r.text for r in W.extract(df).collect()}


def test_slot_found_without_an_article_element(spark):
    bodies = {i: [f"Title {i}", prose(i, 40 + i * 3).replace("\n", " ")] for i in range(30)}
    rows = [(i, f"http://a.example/{i}", site(i, f"<h2>{b[0]}</h2><p>{b[1]}<p>Tail &amp; <b>b</b>old<br>x")) for i, b in bodies.items()]
    got = extracted(spark, rows)
    assert got == {i: f"{b[0]} {b[1]}" for i, b in bodies.items()}  # the same tail on all pages is template
    few = extracted(spark, rows[:5])
    assert few == {i: f"{bodies[i][0]} {bodies[i][1]} Tail & bold x" for i in range(5)}


def test_article_text_is_kept_whole(spark):
    rows = [(i, "http://b.example/x", f"<nav>m {i}</nav><article><h1>H {i}</h1><p>Same text of all.</p><p>Same again here.</article><footer>f</footer>") for i in range(20)]
    assert extracted(spark, rows) == {i: f"H {i} Same text of all. Same again here." for i in range(20)}  # copies are no template


def test_template_line_inside_the_article_goes(spark):
    rows = [(i, "http://c.example/x", f"<article><p>{prose(i, 60)}</p><p>Share this story</p><div class='comments'>No {i}</div></article>") for i in range(20)]
    assert extracted(spark, rows) == {i: " ".join(prose(i, 60).split()) for i in range(20)}


def test_edge_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "no url", "plain &lt;text&gt; &nbsp; only"), (4, "http://h.example:80/a", "<p>one<p>two<!-- <p>no -->three<script>x</script>"),
        (5, "http://u@H.Example/b", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "http://h.example/c", "<p>" + "long " * 50000 + "</p>"),
        (7, "http://i.example/", "<article>a < b <i class=ad>bad</i> c</article>"), (None, "http://i.example/", "<article>x</article>"), (7, "http://i.example/", "<article>a < b <i class=ad>bad</i> c</article>"),
    ]
    got = extracted(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "plain <text> only" and got[4] == "one twothree" and got[5] == "deep"
    assert got[6] == ("long " * 50000).strip() and got[7] == "a < b c" and got[None] == "x"
    assert extracted(spark, []) == {}


def test_registered_pages(spark, sf_dir):
    rows = QUERIES["op13_html_extraction"](spark, sf_dir)
    assert rows.columns == ["page_id", "url", "text", "n_chars"] and rows.where("n_chars <> length(text)").count() == 0
    assert rows.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_matching_equals_all_alignments():
    """Simple tree matching against trying all alignments on small trees."""

    def best(seed, page, a, b):
        if seed.labels[a] == W.TEXT:
            return 1.5 if seed.hashes[a] == W._hash(page.texts[b]) else 1.0
        ka, kb = seed.children[a], page.children[b]
        top = 0.0
        for n in range(min(len(ka), len(kb)) + 1):
            for x in itertools.combinations(ka, n):
                for y in itertools.combinations(kb, n):
                    if all(seed.labels[i] == page.labels[j] for i, j in zip(x, y, strict=True)):
                        top = max(top, sum(best(seed, page, i, j) for i, j in zip(x, y, strict=True)))
        return 1 + top

    def worth(seed, page, matched):
        return sum(1.5 if seed.labels[s] == W.TEXT and seed.hashes[s] == W._hash(page.texts[n]) else 1.0 for n, s in matched.items())

    r = random.Random(3)
    tree = lambda d: "".join(f"<{t}>{r.choice(['a', 'b', ''])}{tree(d - 1) if d else ''}</{t}>" for t in r.choices(["div", "ul", "section"], k=r.randint(1, 3)))
    for _ in range(40):
        seed, page = W.Seed.of(W.parse(tree(2))), W.parse(tree(2))
        assert worth(seed, page, W.align(seed, page)) == best(seed, page, 0, 0)
