"""Whole queries on small tables made for the cases that the driver tables hardly hold."""

from collections import defaultdict

from kbspark.plans import registry


def packed(tokens, records_most=12, tokens_most=6000):
    """The batch of each record, packed in order."""
    batches = []
    for t in tokens:
        if not batches or len(batches[-1]) == records_most or sum(batches[-1]) + t > tokens_most:
            batches.append([])
        batches[-1].append(t)
    return [i for i, b in enumerate(batches) for _ in b]


def test_planner_keeps_groups_over_the_token_budget(spark, tmp_path):
    words = [8, 1500, 40, 5000, 900, 2300, 3]
    docs = [(i, " ".join(["w"] * n) + ". rest of it") for i, n in enumerate(words)]
    orders = [(o, 71 * (o % 2 - o) % 200, "O", "1-URGENT") for o in range(1, 120)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, "red pump", "A", "B", 1) for i in range(2)], "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")

    suffix = [2, 3, 4, 2, 2, 3, 4, 2, 11, 3, 6, 5]  # words that the logical table adds to a text
    groups = defaultdict(list)
    for o, c, *_ in orders:
        if o % 17 and o % 13:
            groups[(31 * c + o) % 2].append((o, (words[o % len(words)] + 3 + suffix[o % 12]) * 13 // 10))
    assert len(groups) == 2 and all(sum(t for _, t in g) > 6000 for g in groups.values()) and any(t > 6000 for g in groups.values() for _, t in g)
    want = {(e, "red pump (a)", o, b) for e, g in groups.items() for (o, _), b in zip(g, packed([t for _, t in g]))}
    got = [tuple(r) for r in registry.QUERIES["l5_batch_planner"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
