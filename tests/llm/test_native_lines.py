"""Line dedup in DataFrame functions alone, against a comparison of all pairs."""

import random

from cubeweave.llm import _clusters, line_dedup


def test_line_dedup_runs_no_python_and_finds_what_all_pairs_give(spark, monkeypatch):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäß日本😀 "
    lines = []
    for _ in range(6):
        # Copies of copies: not all are like one pivot, so that buckets stay open after it.
        family = ["".join(r.choices(letters, k=200))]
        while len(family) < 25:
            line = list(r.choice(family))
            for at in r.sample(range(len(line)), 2):
                line[at] = r.choice(letters)
            family.append("".join(line))
        lines += family
    lines = [x.strip() for x in lines]
    sets = [{t[k : k + 8] for k in range(len(t) - 7)} for t in lines]
    comp = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if comp[i] != comp[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    plans, labels, write = [], [], line_dedup.materialise

    def watched(df, label, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        labels.append(label)
        return write(df, label, *more)

    monkeypatch.setattr(line_dedup, "materialise", watched)
    monkeypatch.setattr(_clusters, "materialise", watched)
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(2))
    kept = {x["doc_id"] for x in out.collect() if x["n_removed"] == 0}
    # What makes the table's rows is the test's own.
    assert not any(word in plan for plan in plans[1:] for word in ("InArrow", "InPandas", "Python"))
    assert "ArrowEvalPython" not in plans[0] and "MapInArrow" not in plans[0]
    assert "line-block-tried" in labels
    assert kept == {comp.index(c) for c in comp}


def test_line_dedup_leaves_only_its_last_pass_on_disk(spark):
    from pathlib import Path

    from cubeweave.llm._scratch import shared_dir

    r = random.Random(11)
    below = Path(shared_dir(spark).removeprefix("file:")) / "cubeweave"
    before = set(below.glob("*"))
    lines = ["".join(r.choices("abcdefghij klmnop", k=60)).strip() for _ in range(40)]
    texts = ["\n".join(r.choices(lines, k=5)) for _ in range(60)]
    # Rows of both equal are one document, also where a line is fetched by its place.
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(docs)
    left = set(below.glob("*")) - before
    assert {x.name.rsplit("-", 1)[0] for x in left} == {"line-gone"}
    assert sum(len(x["text"].split("\n")) for x in out.collect() if x["text"]) == 2 * len({x for t in texts for x in t.split("\n")})
