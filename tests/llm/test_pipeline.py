import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import docs
from tests.llm.test_operators import WORDS, deduped, groups_of, odd, prose, raw, spans
from tidemark.llm import bpe, decontaminate, quality, simhash


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark with junk, shared lines, copies and leaks."""
    rng, d = random.Random(21), str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(rng, 30)) for i in range(6)]
    shared = [prose(rng, 60) for _ in range(3)]
    rows, marks = [], []
    for i in range(260):
        good = i % 4 != 0
        text = "\n".join(prose(rng, rng.randint(25, 50)) + "." for _ in range(rng.randint(2, 5)))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([rng.choice(WORDS)] * 120), text.replace(" ", " ### ")])
        elif i % 13 == 1:
            text += "\n" + rng.choice(shared)
        elif i % 17 == 2:
            text += "\n" + rng.choice(items)[1]
        rows.append((i, text))
        marks.append((i, int(good), 0))
    for k in range(20):  # exact and near copies
        w = rows[k * 7 + 1][1].split(" ")
        if k % 2:
            w[3] = "changed"
        rows.append((300 + k, " ".join(w)))
    rows += [(400, None), (401, ""), rows[5]]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_matches_brute_force_on_its_input(spark, corpus, tmp_path):
    d, items = corpus
    now = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "decontamination", "encode"]
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(now)
        stage(spark, now, d).write.parquet(f"{tmp_path}/{name}")
        after_df = spark.read.parquet(f"{tmp_path}/{name}")
        after = pairs(after_df)
        if name != "encode":
            assert after_df.columns == columns
        if name == "quality":
            model = quality.train(now, spark.read.parquet(f"{d}/labels.parquet"))
            x = quality.with_statistics(now, lexicon=model.lexicon).select("doc_id", "text", *quality.NAMES).toPandas()
            score = model.predict(x[list(quality.NAMES)].to_numpy(float), list(quality.NAMES))
            keep = (score >= quality.THRESHOLD) & x["text"].fillna("").str.len().gt(0).to_numpy()
            assert sorted(after, key=repr) == sorted(((None if i is None else int(i), t) for i, t, k in zip(x["doc_id"], x["text"], keep) if k), key=repr)
            junk = {i for i in range(260) if i % 4 == 0}
            assert not junk & {i for i, _ in after} and len(after) >= 195
        elif name == "lines":
            assert sorted(after, key=repr) == deduped(before, [g for g in groups_of(sorted(set(before), key=repr), simhash.DISTANCE) if len(g) > 1])
        elif name == "near_duplicates":
            want = []
            for g in groups_of(before, simhash.DISTANCE):
                want.append(min(g, key=lambda x: (x is None, x)))
            assert sorted(i for i, _ in after) == sorted(want)
        elif name == "decontamination":
            least = decontaminate.GRAM + decontaminate.WINDOW - 1
            bad = {i for i, *_ in spans(before, items, least)}
            assert bad and sorted(after, key=repr) == sorted(((i, t) for i, t in before if i not in bad), key=repr)
        else:
            assert sorted(after, key=repr) == sorted(before, key=repr)
            assert after_df.where("not round_trip or n_tokens <> size(ids)").count() == 0
            back = bpe.decode(after_df).where(~F.col("decoded").eqNullSafe(F.col("text")))
            assert back.count() == 0
        now = after_df
    ran = corpus_pipeline.run(spark, d)
    assert sorted(pairs(ran), key=repr) == sorted(pairs(now), key=repr) and {"ids", "n_tokens"} <= set(ran.columns)


def test_stages_take_odd_and_empty_tables(spark, corpus):
    d, _ = corpus
    for rows in (odd(spark, ["ids", "score", "rk", "a.b"]), odd(spark).limit(0), raw(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, d).count()


def test_no_line_is_left_twice(spark, tmp_path):
    """After near-dedup, lines that copies kept for it are there once."""
    d, now = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, now, d).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    left = now.select(F.explode(F.split("text", "\n")).alias("line")).where(r"line rlike '\\S'")
    assert left.count() == left.distinct().count() > 500
