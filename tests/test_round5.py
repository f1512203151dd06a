"""Queries whose stages are read more than once."""

from pyspark.sql import functions as F


def test_detokenize_reads_documents_for_its_stages_only(spark, tmp_path):
    from posttrain.plans.q_text import q_detokenize
    texts = [(1, "a b  a\n"), (2, ""), (3, None), (4, "b, b! éa"), (5, "x")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    out = q_detokenize(spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]  # ids and vocabulary are stored
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i, t or "") for i, t in texts]


def test_rare_pieces_meet_the_vocabulary_in_a_join_and_frequent_ones_do_not(spark, monkeypatch):
    import random
    import re

    from posttrain.operators import vocab
    monkeypatch.setattr(vocab, "HEAD", 5)  # ids from 6 on are rare
    monkeypatch.setattr(vocab, "HEAD_BYTES", 6)
    r = random.Random(3)
    words = ["a", "bb", "\u4e2d" * 4, "\u00e9", "_x", "!", "\U0001F600", *(f"w{i}" for i in range(40))]
    texts = ["".join(r.choice(words) + r.choice([" ", "", "\n\t"]) for _ in range(r.choice([0, 1, 5, 80]))) for _ in range(60)] + [None, ""]
    # keys repeat and are null
    rows = [(None if i % 9 == 0 else i // 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, text string").repartition(3)
    cut = {t: re.findall(r"[\x20\x09-\x0D]+|[0-9A-Za-z_]+|[^\x20\x09-\x0D0-9A-Za-z_]+", t or "") for t in texts}
    counts = {}
    for t in texts:
        for p in cut[t]:
            counts[p] = counts.get(p, 0) + 1
    order = sorted((p for p in counts if counts[p] >= 3), key=lambda p: (-counts[p], p.encode()))
    number = {p: i for i, p in enumerate(order, 1)}
    v = vocab.build_vocabulary(df, min_count=3)
    assert sorted((x.id, x.piece, x.n) for x in v.collect()) == [(number[p], p, counts[p]) for p in order]
    v = spark.createDataFrame([(p, i) for p, i in number.items()], "piece string, id long")
    for most in (None, 7):
        ids = vocab.encode(df, v, ["k"], max_length=most)
        want = [(k, [number.get(p, 0) for p in cut[t][:most]]) for k, t in rows]
        assert sorted(((x.k, x.ids) for x in ids.collect()), key=str) == sorted(want, key=str)
        back = vocab.decode(ids, v, ["k"], unknown="?")
        names = dict(enumerate(order, 1))
        assert sorted(((x.k, x.text) for x in back.collect()), key=str) == sorted(((k, "".join(names.get(i, "?") for i in x)) for k, x in want), key=str)


def test_decode_takes_null_lists_null_ids_and_ids_without_a_piece(spark):
    from posttrain.operators import vocab
    v = spark.createDataFrame([("a", 1), ("b", 2), ("far", 1 << 40)], "piece string, id long")
    rows = [(1, [1, None, 2]), (2, None), (3, []), (4, [1 << 40, 0, 9, -3, 1 << 41]), (5, [1 << 40, 1 << 40])]
    got = vocab.decode(spark.createDataFrame(rows, "k long, ids array<long>"), v, ["k"], unknown="?").collect()
    assert sorted((r.k, r.text) for r in got) == [(1, "a?b"), (2, ""), (3, ""), (4, "far????"), (5, "farfar")]


def test_tokenize_vocabulary_keeps_rows_of_one_key_apart(spark, tmp_path):
    from posttrain.plans.q_text import q_tokenize_vocabulary
    rows = [(1, 0, "a b a"), (1, 0, "b a"), (1, 0, "b a"), (2, None, "a"), (2, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r.ids, r.decoded) for r in q_tokenize_vocabulary(spark, str(tmp_path)).collect())
    # by falling count: "a" 5, " " 4, "b" 3
    assert got == [(1, 0, "1,2,3,2,1", "a b a"), (1, 0, "3,2,1", "b a"), (1, 0, "3,2,1", "b a"), (2, 1, "", "")]
