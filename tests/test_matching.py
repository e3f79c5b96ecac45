"""Names matched by shared bigrams, against all pairs."""

from stopwise.functions.textcols import bigrams, normalize_name
from stopwise.operators import matching


def test_wide_keys_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(matching, "FEW_PAIRS", 0)
    monkeypatch.setattr(matching, "PAIRS_PER_ROW", 0)
    texts = [(f"Halt {k * 7919 % 10007:05d}" + ("" if k % 3 else " West"),) for k in range(60)] + [("",), ("a",), ("zz",), (None,)]
    names = spark.createDataFrame(texts + texts[:5], "name string")
    candidates = spark.createDataFrame([(f"halt{k * 104729 % 99991:05d}" + ("" if k % 4 else "-Ost"),) for k in range(150)] + [("",), ("A",), (None,)], "candidate string")
    sets = lambda df, c: {r[0]: set(r[1]) for r in df.select(c, bigrams(normalize_name(df[c]))).distinct().collect() if r[0] is not None}
    one, two = sets(names, "name"), sets(candidates, "candidate")
    widths = []
    monkeypatch.setattr(matching, "_both_keys", lambda a, r, width, needs, real=matching._both_keys: widths.append(width) or real(a, r, width, needs))
    for cutoff in (0.0,):
        found = {r.name: (r.match, round(r.similarity, 9)) for r in matching.fuzzy_name_match(names, candidates, cutoff).collect()}
        expected = {}
        for n, a in one.items():
            scores = [(-2 * len(a & b) / (len(a) + len(b)), c) for c, b in two.items() if a & b]
            if scores and -min(scores)[0] >= cutoff:
                expected[n] = (min(scores)[1], round(-min(scores)[0], 9))
        assert found == expected
    assert max(widths) >= 3
