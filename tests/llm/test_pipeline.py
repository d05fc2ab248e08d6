"""Every stage on its own input, and the whole."""

import collections

import corpus_pipeline
from tessera.llm import packing

from .test_operators import naive_classes, words


def test_stages(spark, docs, tmp_path):
    rows = [(i, words(i, 120 + i), "en", f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(200 + i, rows[i][1].replace(rows[i][1].split()[9], "edit"), "en", "s1") for i in range(10)]
    rows += [(300, "too short", "en", "s0"), (301, None, None, None), (302, " | ".join(words(1, 90).split()), "en", "s0")]
    at, counts = docs(*rows).drop("digest"), []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        counts.append(at.count())
        if name != "pack":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            held = {r.doc_id: r.text for r in at.collect()}
            assert sorted(held) == list(range(90)) and len(set(naive_classes(list(held.values())))) == 90
        if name == "mix":
            mixed = at.collect()
            assert all(r.n_chars == len(r.text) for r in mixed) and {r.doc_id for r in mixed} <= set(held)
            taken = collections.Counter()
            for r in mixed:
                taken[r.doc_id] += len(r.text.split())
            assert all(n <= 2 * len(held[i].split()) for i, n in taken.items())
            assert abs(sum(taken.values()) - 1.5 * sum(len(t.split()) for t in held.values())) < 400
    assert counts[:3] == [110, 100, 90]
    full = at.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in full) <= 2048 and at.agg({"length": "sum"}).first()[0] == packing.pack(spark.read.parquet(str(tmp_path / "mix"))).agg({"length": "sum"}).first()[0]
