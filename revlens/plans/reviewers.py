"""Reviewers that stand in for a real one in queries and tests."""

from __future__ import annotations

import json

import pandas as pd


def stub_responder(prompts: pd.Series) -> pd.Series:
    """Deterministic test reviewer: one suggestion whose priority and impact
    come from the prompt length (so the oracle can recompute it)."""
    pri = ["Low", "Medium", "High", "Critical"]
    n = prompts.str.len()
    return pd.Series(
        [
            json.dumps({"suggestions": [{"priority": pri[k % 4], "impactScore": str(k % 12), "title": f"len {k}"}]})
            for k in n
        ],
        index=prompts.index,
    )


def fragile_responder(prompts: pd.Series) -> pd.Series:
    """Test reviewer that fails on prompts whose length ends in 3."""
    if (prompts.str.len() % 10 == 3).any():
        raise RuntimeError("no answer")
    return stub_responder(prompts)
