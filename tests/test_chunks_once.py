"""Chunks are cut once, written down, and only hashes and scores are shuffled to find the first of each content."""

from scriptorium.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_no_chunk_is_cut_again_for_the_result(spark):
    for name in ("index_sources", "ingested_books"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "array_join" not in plan and "documents.parquet" not in plan, name


def test_a_book_is_cut_without_its_words_in_one_row(spark):
    import random

    from pyspark.sql import functions as F

    from scriptorium.operators import archive, chunk, dedup, textometrics

    rng = random.Random(11)
    words = ["mot" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(676)] + ["Fin.", "Quoi?", "été", " x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = [(0, k, text(rng.choice([0, 1, 3, 20, 250, 300, 301, 700]))) for k in range(120)]
    pages += [(b, 0, text(n)) for b, n in enumerate([250, 299, 300, 301, 302, 550, 551, 49], 1)]
    same = text(250)
    pages += [(20, k, same) for k in range(9)] + [(21, 0, None), (21, 1, " \n"), (22, 5, text(400)), (22, 4, text(10))]
    df = spark.createDataFrame(pages, "doc_id long, page_number long, text string").repartition(3)
    clean = archive.preprocessed(df)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n")
    chunks = chunk.fixed_chunks(clean.groupBy("doc_id").agg(body.alias("text")))
    rated = textometrics.quality(chunks.select(F.struct("doc_id", "chunk_index", "content").alias("id"), F.col("content").alias("text")), "id").filter("rejected is null")
    first = {}
    for r in sorted(rated.select("id.*", "score", dedup.content_hash(F.col("id.content")).alias("h")).collect()):
        first.setdefault((r.doc_id, r.h), (r.doc_id, r.chunk_index, r.content, r.score))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        for parts in ("4", "40"):  # more tasks than a window has pages, too
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set(coalesce, "false")
            got = [tuple(r) for r in archive.ingested(df).collect()]
            assert sorted(got) == sorted(first.values()) and len(got) > 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset(coalesce)


def test_what_a_row_holds_does_not_grow_with_the_book(spark, monkeypatch):
    from scriptorium.operators import archive

    longest, stored = [], archive.stored

    def seen(df):
        out = stored(df)
        for c in {"body", "text", "content"} & set(out.columns):
            longest.append(out.selectExpr(f"max(length({c}))").first()[0])
        return out

    asked = []
    fixed = archive.chunk.fixed_chunks
    monkeypatch.setattr(archive, "stored", seen)
    monkeypatch.setattr(archive.chunk, "fixed_chunks", lambda df, *a: asked.append(df.selectExpr("max(length(text))").first()[0]) or fixed(df, *a))
    pages = [(1, k, " ".join("mot" + chr(97 + (k * 31 + i * 7) % 26) + chr(97 + (k + i) % 25) for i in range(100)) + ".") for k in range(200)]
    found = archive.ingested(spark.createDataFrame(pages, "doc_id long, page_number long, text string")).collect()
    assert len(found) == 80 and max(longest + asked) < 3000
