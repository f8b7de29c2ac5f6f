from revlens.functions import csharp
from revlens.operators import diffs as DF
from revlens.operators import rules as R


def _files(spark, diff, parity=False):
    df = spark.createDataFrame([("a", diff)], "analysis_id string, diff string")
    return [tuple(r) for r in DF.changed_files(df, parity=parity).select("file_idx", "file_path", "content").collect()]


def test_diff_boundaries(spark):
    d = "\n".join(
        [
            "preamble",
            "diff --git a/x.cs b/src/X.CS",
            "+++ b/src/X.CS",
            "+int a;",
            "+++i;",
            " ctx",
            "-old",
            "diff --git a/only.cs b/only.cs",
            "-removed",
            "diff --git a/b/backend/x.cs b/backend/x.cs",
            "+y",
        ]
    )
    got = _files(spark, d)
    assert got == [(0, "src/X.CS", "int a;\n"), (2, "backend/x.cs", "y\n")]
    assert _files(spark, "diff --git a/x b/b/backend/x.cs\n+z", parity=True) == [(0, "ackend/x.cs", "z\n")]
    assert _files(spark, "") == []
    dup = "diff --git a/p.cs b/p.cs\n+a\ndiff --git a/p.cs b/p.cs\n+b"
    assert [r[1] for r in _files(spark, dup)] == ["p.cs", "p.cs"]
    short = "diff --git a/p.cs b/p.cs\n+a\ndiff --git broken\n+b\ndiff --git a/q.cs b/q.cs\n+c"
    assert _files(spark, short) == [(0, "p.cs", "a\nb\n"), (1, "q.cs", "c\n")]
    crlf = "diff --git a/w.cs b/w.cs\r\n+x\r\n"
    assert _files(spark, crlf) == [(0, "w.cs", "x\r\n")]


def test_extension_filter(spark):
    df = spark.createDataFrame([("a", 0, p, "x\n", 1) for p in ["A.CS", "b.csx", "c.md", "d.cs"]],
                               "analysis_id string, file_idx int, file_path string, content string, added_count int")
    assert sorted(r[0] for r in DF.csharp_files(df).select("file_path").collect()) == ["A.CS", "d.cs"]


def _code(spark, *texts):
    rows = [("a", i, f"f{i}.cs", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "analysis_id string, file_idx int, file_path string, content string")


def _hits(text, max_statements=50):
    """(rule, line, column, text) of one file."""
    out = []
    for f in csharp.scan(text, max_statements):
        out.append((f.rule, text.count("\n", 0, f.at) + 1, f.at - text.rfind("\n", 0, f.at), f.text))
    return out


def _values(text):
    return [(line, col, v) for rule, line, col, v in _hits(text) if rule == "literal"]


def _async(text):
    return [(line, col, v) for rule, line, col, v in _hits(text) if rule == "async_void"]


def _statements(text):
    """Statement counts of the methods, by name order in the text."""
    return [int(v) for rule, _, _, v in _hits(text, 0) if rule == "long_method"]


def test_async_void(spark):
    code = "async void F() {}\nasync Task G() {}\nvoid H() {}\n// async void C() {}\nvar s = \"async void S()\";\npublic static async void K(int x) {}\nprivate async void Gen<T>(T x) {}"
    got = sorted((r["line_number"], r["column_number"], r["suggested_fix"]) for r in R.async_void(_code(spark, code)).collect())
    assert got == [(1, 1, "async Task F(...)"), (6, 1, "async Task K(...)"), (7, 1, "async Task Gen(...)")]


def test_async_void_declarations():
    assert _async("public async void Handle() {\n  async void Local() { }\n}") == [(1, 1, "Handle")]
    assert _async("class C {\n  [Fact]\n  async void T() => F();\n  async Task U() {}\n  async ValueTask<int> V() {}\n}") == [(2, 3, "T")]
    assert _async("interface I { async void A(\n  int x,\n  int y); }") == [(1, 15, "A")]
    assert _async('/* async void A() {}\n async void B() {} */ var s = @"\nasync void C() {}";') == []


def test_literals():
    assert _values("var a = 1e-5 + 6.02e+23 + .5 + 1.50;") == [(1, 9, "1E-05"), (1, 16, "6.02E+23"), (1, 27, "0.5"), (1, 32, "1.5")]
    assert _values("arr[3..7] = x.Item1 + a1;") == [(1, 5, "3"), (1, 8, "7")]
    assert _values('var s = $"{n + 42} 43 {{44}} {x:N5} {(b ? 46 : 47)}" + $@"{48}\n""49""";') == [(1, 16, "42"), (1, 43, "46"), (1, 48, "47"), (1, 60, "48")]
    assert _values("/* 5\n 6 */ f(7); // 8\n#pragma warning disable 618\nvar v = @\"9 \"\" 11\"; var c = '3';") == [(2, 9, "7")]
    assert [v for _, _, v in _values("0xFF 0b101 1_000 100L 1.50m 2.0f 1e3 1e15 0.0001 0x1F_UL 007")] == [
        "255", "5", "1000", "100", "1.50", "2", "1000", "1E+15", "0.0001", "31", "7",
    ]
    assert _values('"""\n 5 """ + 6') == [(2, 10, "6")]
    assert _values("Log(12, 12);") == [(1, 5, "12"), (1, 9, "12")]
    assert _values("'unclosed 5\n6 \"unclosed 7\n8") == [(2, 1, "6"), (3, 1, "8")]


def test_magic_numbers(spark):
    code = "var a = 0 + 1 + 2 + 10 + 100;\nvar b = 3 + 42 + 1024;\nvar x10 = 1;\nvar h = 0x0A + 1.0 + 100L;"
    got = [r["message"] for r in R.magic_numbers(_code(spark, code)).collect()]
    assert sorted(got) == sorted(f"Use a named constant instead of magic number '{v}'" for v in ("3", "42", "1024"))
    many = "\n".join(f"var v{i} = {i + 11};" for i in range(12))
    assert R.magic_numbers(_code(spark, many, many)).count() == 24
    got = R.magic_numbers(_code(spark, many, many), limit=10).collect()
    assert sorted((r["file_idx"], r["line_number"]) for r in got) == [(f, n) for f in (0, 1) for n in range(1, 11)]
    ids = R.finding_ids(R.magic_numbers(_code(spark, "f(12, 12);"))).select("id").distinct().count()
    assert ids == 2


def _method(n):
    body = "\n".join(f"    x{i}();" for i in range(n))
    return f"class C {{\n  public void M() {{\n{body}\n  }}\n  int P() => 1;\n}}"


def test_long_methods(spark):
    got = R.long_methods(_code(spark, _method(50), _method(51))).collect()
    assert [(r["file_idx"], r["line_number"], r["column_number"]) for r in got] == [(1, 2, 3)] and "(51 satır)" in got[0]["message"]
    ctor = "class C {\n  public C() {\n" + "\n".join(f"    x{i}();" for i in range(60)) + "\n  }\n}"
    nested = "class C {\n  void M() {\n" + "\n".join("    if (a) {\n      b();\n    }" for _ in range(51)) + "\n  }\n}"
    assert [r["file_idx"] for r in R.long_methods(_code(spark, ctor, nested)).collect()] == [1]
    assert R.run_rules(_code(spark, "", "}}}}", "{{((")).count() == 0


def test_statement_counts():
    assert _statements("void M() {\n await Foo(1)\n  .Bar();\n return Foo(2);\n throw Foo(3);\n}") == [3]
    assert _statements("void M() { a(); b(); void L() { x(); y(); } c(); }") == [4]
    assert _statements("int M(\n int a,\n int b)\n{\n a();\n}") == [1]
    assert _statements("void M() {" + "\nif (a)\n{\n x();\n}\nelse\n{\n y();\n}" * 26 + "\n}") == [26]
    assert _statements("void M() { for (;;) { a(); } do { x(); } while (c); try { } catch { } finally { } if (a) b(); else c(); }") == [4]
    assert _statements("void M() { var f = () => { q(); }; var o = new X { A = 1 }; switch (x) { case 3: break; } }") == [3]
    assert _statements("class C { int P { get { return 1; } } int Q => 2; void M() => a(); C() { a(); } void N() { a(); ") == [1]


def test_diagnostics_snippet(spark):
    files = spark.createDataFrame([("a", 0, "f.cs", "  first  \nsecond\n")],
                                  "analysis_id string, file_idx int, file_path string, content string")
    diags = spark.createDataFrame(
        [("a", 0, "CS1", "t", "m", sev, line, 0, "Compiler") for sev, line in [("Error", 0), ("Hidden", 1), ("Warning", 9)]]
        + [("b", 0, "CS1", "t", "m", "Error", 4, 0, "Compiler")],
        "analysis_id string, file_idx int, rule_id string, title string, message string, severity string, line0 int, col0 int, category string",
    )
    got = sorted((r["line_number"], r["severity"], r["code_snippet"]) for r in R.diagnostics(diags, files).collect())
    assert got == [(1, 2, "first"), (2, 0, "second"), (5, 2, ""), (10, 1, "")]


def test_odd_literals_have_a_value():
    values = {"1e400": "Infinity", "1e39f": "Infinity", "0x_": "0", "0b_": "0", "9" * 5000: "0", "0x" + "F" * 900: "0", "18446744073709551615": "18446744073709551615",
              "18446744073709551616": "0", "1e400m": "0", "1e-500m": "0", "79228162514264337593543950335m": "79228162514264337593543950335", "0" * 30 + "7": "7"}
    assert {k: csharp.literal_value(k) for k in values} == values


def test_deep_interpolation_and_raw_holes():
    deep = '$"{' * 1500 + "42" + '}"' * 1500
    assert [v for _, _, v in _values(f"var s = {deep};")][-1:] in ([], ["42"])  # read without an error
    assert _values('$"""a {n + 42} b"""') == [(1, 12, "42")]
    assert _values('$$"""a {1} {{n + 42}} {{{43}}} "" b"""; f(44)') == [(1, 18, "42"), (1, 26, "43"), (1, 43, "44")]
    assert _values('"""a {42} b""" + 43') == [(1, 18, "43")]


def test_indented_directives_are_no_code():
    assert _values("class C {\n\n  #region 7 { (\n\t#pragma warning disable 618\n  int a = 8;\n}") == [(5, 11, "8")]
    assert _statements("void M() {\n  a();\n  #if X {\n  b();\n  #endif\n}") == [2]


def test_blocks_and_initialisers_in_statement_counts():
    of = lambda body: _statements("void M() {\n" + body + "\n}")
    assert of("var q = new T { A = a } as U;\n" * 26) == [26]
    assert of("if (a) { b(); }\n++i;\n" * 26) == [52]
    assert of("if (a) { b(); }\n(b).C();\n" * 26) == [52]
    assert of('if (a) { b(); }\n"x".C();\n' * 3) == [6]
    assert of("if (a is { L: 1 }) { b(); } [X] void L() { y(); } *p = 1;") == [3]
    assert of("var f = async () => { q(); }; g += delegate (int x) { y(); }; return a switch { 1 => 2, _ => 3 };") == [3]
    assert of("try { } catch (E e) when (f(e)) { } finally { } { a(); } unsafe { } ; lab: { b(); }") == [5]
    assert of("await foreach (var x in y) { z(); } static T L<T>(T t) where T : class { return t; } (int a, int b) P() { return (1, 2); }") == [3]
    assert of("using (a) using (b) { c(); } new T(1) { A = 2 }.Run(); int[] v = { 1, 2 }; do { x(); } while (c); while (d) { }") == [5]
    assert of('s = $"{(a ? b : c)}"; if (x) { y(); } else if (z) { w(); } else { v(); }') == [2]


def test_explicit_interface_methods():
    assert _async("class C { async void I.F() { } async void N.I<T, U>.G(int x) { } async Task I.H() { } }") == [(1, 11, "F"), (1, 32, "G")]
    assert _async("x.Foo();\nawait a.b();\nasync void G<T>() { }") == [(3, 1, "G")]


ODD_TEXTS = ["f(1e400);", "f(0x_, 0b_);", "f(" + "9" * 5000 + ");", "var s = " + '$"{' * 1500 + "42" + '}"' * 1500 + ";", "{" * 3000 + "}" * 3000, "\x00\ud83d\ude00 5;", '$"{', "@", "'", '"""', "/*"]


def test_one_bad_file_never_fails_the_others(spark):
    files = _code(spark, *ODD_TEXTS, "f(12);")
    got = R.magic_numbers(files).collect()
    assert [r["message"] for r in got if r["file_idx"] == len(ODD_TEXTS)] == ["Use a named constant instead of magic number '12'"]
    assert R.unread_files(files).count() == 0


def test_unreadable_file_is_one_hit_of_its_own_kind(monkeypatch):
    def scan(text, most):
        raise ValueError(text)

    monkeypatch.setattr(csharp, "scan", scan)
    assert R.positions("f(7);", 50) == [(R.UNREAD, 1, 1, "ValueError")]


def test_decimals_of_any_exponent():
    huge = "9" * 19
    assert [v for _, _, v in _values(f"f(1e{huge}m, 1.5e-{huge}M, 0e{huge}m, 7);")] == ["0", "0", "0", "7"]


def failing_positions():
    """`positions` that fails on texts with the word unreadable."""
    read = R.positions

    def positions(text, most):
        return [(R.UNREAD, 1, 1, "ValueError")] if "unreadable" in (text or "") else read(text, most)

    return positions


def test_unread_file_does_not_look_like_one_without_findings(spark, monkeypatch):
    monkeypatch.setattr(R, "positions", failing_positions())
    files = _code(spark, "f(7); // unreadable", "f(1);", "f(12);")
    for found in (R.run_rules(files), R.magic_numbers(files, limit=1)):
        got = {r["file_idx"]: (r["rule_id"], r["severity"], r["message"], r["line_number"]) for r in found.collect()}
        assert got == {0: (R.UNREAD_ID, 2, R.UNREAD_MESSAGE % "ValueError", 1), 2: (R.MAGIC_ID, 0, R.MAGIC_MESSAGE % "12", 1)}
    assert [tuple(r) for r in R.unread_message(R.run_rules(files)).collect()] == [("a", "f0.cs: " + R.UNREAD_MESSAGE % "ValueError")]
    assert [r["file_idx"] for r in R.unread_files(files).collect()] == [0]


def test_guards_never_hide_a_hit(spark):
    texts = ["async void F() {}", "async\nvoid F() {}", "f(.5);", "a[3..7]", "x=1", "é5", "5", '$"{n+42}"', "1_0", "-3", "x1 + y2", _method(51), _method(50), "void M() {" + "{ }" * 51 + "}"] + ODD_TEXTS
    files = _code(spark, *texts).withColumn("n", R.F.col("file_idx"))
    for kind in R.RULES:
        rows = files.select("content", R.may_hit(R.F.col("content"), kind).alias("may")).collect()
        for r in rows:
            hit = any(f.rule == kind for f in csharp.scan(r["content"], R.LONG_MAX_STATEMENTS))
            assert r["may"] or not hit, (kind, r["content"])
