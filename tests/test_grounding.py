"""Grounding and rows of boxes against plain loops."""

import re

import numpy as np

from foliospark.operators import grounding as G
from foliospark.operators import pages as P


def test_quotes_over_lines(spark):
    """Quotes across line ends, repeated words, signs, other claims' words, no words at all; a long evidence."""
    evidence = [("a", 0, "The total is 1,200 due"), ("a", 1, "on 2024-03-01. Total total"), ("a", 2, None), ("a", 3, "ok"), ("b", 0, "is due on time")]
    evidence += [("c", k, f"line {k} of the same words") for k in range(3000)]
    quotes = {"a": ["due on", "DUE ON 2024", "total total ok", "total ok total", "is due", "1,200", "1200", "...", "ok", ". Total", "total is 1,2"], "b": ["is due", "due on 2024"], "c": ["words line 2500 of the", "words line 2500 the", "same words line"]}
    q = spark.createDataFrame([(c, v) for c, vs in quotes.items() for v in vs], "claim string, v string")
    got = {tuple(r) for r in G.quotes_found(q, spark.createDataFrame(evidence, "claim string, line_no int, text string")).collect()}
    words = lambda t: " " + " ".join(re.findall(G.TOKEN, t.lower())) + " "
    text = {c: words("\n".join(t or "" for k, _, t in evidence if k == c)) for c in quotes}
    assert got == {(c, v) for c, vs in quotes.items() for v in vs if words(v).strip() and words(v) in text[c]}
    assert ("a", "due on") in got and ("b", "due on 2024") not in got and ("c", "words line 2500 the") not in got


def test_answers_under_both_policies(spark):
    fields = spark.createDataFrame([("b1", "a", "costs 1200", ["e1", "x"]), ("b2", "a", "on 2031-01-01", ["e1"]), ("b3", "a", "nothing stated", []), ("b4", "z", "says 'hi'", None)], "block_id string, claim string, text string, cites array<string>")
    evidence = spark.createDataFrame([("a", 0, "it costs 1,200")], "claim string, line_no int, text string")
    got = {r.claim: tuple(r)[1:] for r in G.answers(fields, evidence, spark.createDataFrame([("a", "e1"), ("z", "x")], "claim string, id string")).collect()}
    assert got == {"a": (2, True, 0.6666, "e1", 1), "z": (1, False, 1.0, "", 0)}


def test_rows_follow_their_mean(spark):
    rng = np.random.default_rng(7)
    rows = [(p, 1, k, float(rng.integers(0, 5) * 50), float(y := rng.integers(0, 60)), float(y + 12)) for p in range(6) for k in range(25)]
    df = spark.createDataFrame(rows, "source_id long, page_number long, line_no long, x1 double, y1 double, y2 double")
    want = {}
    for p in range(6):
        out = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[4], r[3], r[2])):
            mean = np.mean([x[4] + 6 for x in out[-1]]) if out else None
            out[-1].append(r) if out and abs(r[4] + 6 - mean) < 0.6 * 12 else out.append([r])
        for i, row in enumerate(out):
            for j, r in enumerate(sorted(row, key=lambda r: (r[3], r[2]))):
                want[p, r[2]] = (i, j)
    assert {(r.source_id, r.line_no): (r.grid_row, r.grid_col) for r in P.grid_rows(df).collect()} == want


def test_grounding_in_rows_and_by_index(spark):
    """The same rows whichever way evidence is held, or part of it each way; in rows no word is shuffled, only lines."""
    evidence = spark.createDataFrame([("a", 0, "costs 1,200 until"), ("a", 1, None), ("a", 2, "2024-03-01, said Ann."), ("b", 0, "7"), ("b", 1, "8 on 2031-01-01"), (None, 0, "5")], "claim string, line_no int, text string")
    texts = [("b1", "a", 'pays 1200 and "until 2024-03" and "ann ."'), ("b2", "a", '3.5 "said ann" 3.5 "..." 2024-03-02'), ("b3", "a", "nothing"), ("b4", "b", "8, 7 and 78"), ("b5", "z", '1 "7"'), ("b6", None, "5"), ("b1", "b", "1200"), ("b7", "a", None), ("b8", "b", '"7 8 on" "7 on"')]
    claims = spark.createDataFrame(texts, "block_id string, claim string, text string")
    # figures inside quotes count as figures, too, and the parts of a date as numbers
    want = {"b2": "date:2024-03-02,number:02,number:3.5,quote:...", "b4": "number:78", "b5": "number:1,number:7,quote:7", "b6": "number:5"}
    got = [{tuple(r) for r in G.ground(claims, evidence, most).collect()} for most in (1 << 16, 20, 0)]
    assert got[0] == got[1] == got[2]
    assert {r[0]: r[1] for r in got[0] if r[0] in want} == want and {r[0] for r in got[0]} == {*want, "b1", "b8"}
    plan = G.ground(claims, evidence)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 3
