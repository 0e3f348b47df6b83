"""Decisions look at contexts only where they can matter, and the lookup moves digests, not lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import rounds
from lineweave.plans import lookup


def test_only_forms_with_several_translations_meet_by_context(spark, monkeypatch):
    met = []
    whole = rounds.best_by_context
    monkeypatch.setattr(rounds, "best_by_context", lambda cases, candidates: met.append((cases, candidates)) or whole(cases, candidates))
    row = "baseline_id long, form string, previous array<long>, following array<long>"
    rows = spark.createDataFrame([(1, "one", [], []), (2, "two", [7, 8, 9], []), (3, "two", [5], []), (4, "none", [], []), (5, "blank", [], []), (6, "same", [], [])], row)
    held = "form string, source_id long, korean_key string, s_previous array<long>, s_following array<long>"
    candidates = [
        ("one", 10, "a", [1], []), ("one", 11, "", [], []), ("two", 12, "a", [1], []), ("two", 13, "b", [7, 8, 9], []), ("blank", 14, "", [], []), ("same", 15, "c", [], []), ("same", 16, "c", [], []),
        ("alone", 17, "x", [], []), ("alone", 18, "y", [], []),
    ]
    got = {r["baseline_id"]: tuple(r)[1:] for r in rounds.decide(rows, spark.createDataFrame(candidates, held), keep_best=True).collect()}
    assert got == {
        1: (2, 1, 1, 10, "unique", 10), 2: (2, 0, 2, 13, "context", 13), 3: (2, 0, 2, None, "pending", 12), 4: (0, 0, 0, None, "unmatched", None), 5: (1, 1, 0, None, "all_missing", None), 6: (2, 0, 1, 15, "unique", 15),
    }
    (cases, sources) = met[0]
    assert {r["form"] for r in cases.collect()} == {"two", "same"} == {r["form"] for r in sources.collect()}


def test_the_lookup_stores_no_lines(spark, monkeypatch):
    longest = []
    stored = lookup.settle

    def settle(df, label):
        out = stored(df, label)
        longest.extend(out.agg(F.max(F.length(c))).first()[0] or 0 for c, kind in out.dtypes if kind == "string" and c not in ("path", "sheet"))
        return out

    monkeypatch.setattr(lookup, "settle", settle)
    long = "word " * 500
    form = "path string, sheet string, row int, text string, plain_text string"
    b = spark.createDataFrame([(i, "b", "s", i, t, t) for i, t in enumerate((long + "a", long + "b,", long + "c"), 1)], f"baseline_id long, {form}")
    s = spark.createDataFrame([(i, "a", "s", i, t, t, "k") for i, t in enumerate((long + "a", long + "b，", long + "c (x)"), 1)], f"source_id long, {form}, korean_key string")
    assert {r["baseline_id"]: r["source_id"] for r in lookup.cascade(b, s).collect()} == {1: 1, 2: 2, 3: 3}
    assert max(longest) <= 32
