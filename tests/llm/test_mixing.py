"""Mixing: apportionment, caps, shares."""

import random

import pytest

from ledgerloom.llm import mixing


def one_by_one(weights, seats, caps):
    held = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if weights[i] > 0 and held[i] < caps[i]]
        if not free:
            break
        held[max(free, key=lambda i: (weights[i] / (2 * held[i] + 1), -i))] += 1
    return held


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 6)
        weights = [rng.choice([0, 0.1, 0.25, 0.5, rng.random()]) for _ in range(n)]
        caps = [rng.choice([0, 3, 10, 1000]) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert mixing.sainte_lague(weights, seats, caps) == one_by_one(weights, seats, caps)
    assert mixing.sainte_lague([], 5) == []
    assert sum(mixing.sainte_lague([0.3, 0.7], 10**9)) == 10**9


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Big", " big ", "mid", None, "tiny-src" if i % 50 == 0 else "BIG"]), "word " * rng.randint(0, 60)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, s, "en") for i, s, t in docs], "doc_id bigint, text string, source string, lang string")
    return mixing.sized_documents(df).cache()


def test_shares_and_caps(spark, sized):
    targets = spark.createDataFrame([("p", "big", 0.5, 1, 0.4), ("p", "mid", 0.3, 2, 0.4), ("p", "tiny_src", 0.2, 3, 0.4), ("p", "gone", 0.1, 9, 0.4), ("q", "mid", 1.0, 4, 0.1)], "plan_id string, source string, target_share double, max_repeats int, budget_ratio double")
    quota = mixing.apportion(sized, targets, block=64, shard_tokens=4096)
    mixed = mixing.mix(sized, quota).cache()
    total = sized.agg({"n_tokens": "sum"}).first()[0]
    shares = {(r["plan_id"], r["source"]): r for r in mixing.reached_shares(mixed, targets, quota).collect()}
    caps = {("p", "big"): 1, ("p", "mid"): 2, ("p", "tiny_src"): 3, ("q", "mid"): 4}
    for r in mixed.collect():
        assert 1 <= r["copies"] <= caps[r["plan_id"], r["source"]]
    assert shares["p", "gone"]["tokens"] == 0 and shares["p", "tiny_src"]["most_copies"] == 3
    assert abs(shares["q", "mid"]["tokens"] / (0.1 * total) - 1) < 0.05 and shares["q", "mid"]["actual_share"] == 1.0
    assert abs(sum(r["tokens"] for k, r in shares.items() if k[0] == "p") / (0.4 * total) - 1) < 0.05
    assert abs(shares["p", "big"]["tokens"] / shares["p", "mid"]["tokens"] - 5 / 3) < 0.1
    assert all(abs(r["tokens"] - r["quota_tokens"]) <= 64 for r in shares.values())
    assert not shares["p", "tiny_src"]["has_room"] and shares["p", "big"]["has_room"]
    again = mixing.mix(sized, mixing.apportion(sized, targets, block=64, shard_tokens=4096))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_sources_under_a_block_take_part():
    totals = [("big", 0, 50_000), ("tiny", 0, 300), ("odd", 0, 700)]
    got = mixing.quotas(totals, [("big", 0.5, 1), ("odd", 0.3, 2), ("tiny", 0.2, 1)], 20_000, 512)
    assert ("tiny", 0, 1, 0) in got and ("odd", 0, 2, 0) in got
    assert mixing.quotas(totals, [("big", 0.5, 1), ("tiny", 0.5, 0)], 20_000, 512) == [("big", 0, 0, 39 * 512)]


def test_empty(spark, sized):
    none = spark.createDataFrame([], "plan_id string, source string, target_share double, max_repeats int, budget_ratio double")
    assert mixing.mix(sized, mixing.apportion(sized, none)).count() == 0
    some = spark.createDataFrame([("p", "big", 0.5, 1, 0.4)], none.schema)
    assert mixing.mix(sized.limit(0), mixing.apportion(sized.limit(0), some)).count() == 0
