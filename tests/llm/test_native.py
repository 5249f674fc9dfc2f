from collections import defaultdict

import pytest

from sheafline.llm import line_frequency, mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, shard string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", "b", "c") for i, t, s in rows], SCHEMA)


def words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_line_frequency(spark):
    shared = "Read more on our site"
    rows = [(i, words(i, 30) + f"\n{shared}\n" + words(-i, 5), "h") for i in range(1, 9)]
    rows += [(20, f"{shared.upper()}  \nSolo line of six words here", "h"), (21, None, "h"), (22, "", None), (23, " \n\t\n", None), (24, words(1, 400), None), (25, "a b c d e " * 6, "h"), (25, "a b c d e " * 6, "h")]
    got = defaultdict(list)
    for r in line_frequency.frequent_lines(spark, frame(spark, rows), max_documents=3).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].kept and got[i][0].n_removed_words == 5 for i in range(1, 9))
    assert got[20][0].n_removed_words == 5 and not got[20][0].kept
    assert all(got[i][0].base_failed and got[i][0].n_words == 0 for i in (21, 22, 23))
    assert got[24][0].kept
    assert len(got[25]) == 2 and got[25][0].n_repeat_words == 30 and got[25][0].base_failed
    assert line_frequency.frequent_lines(spark, frame(spark, rows).limit(0)).count() == 0


def test_line_frequency_of_rows_without_ids(spark):
    text = "Read more here\n" + words(1, 20)
    rows = [(-1, text, "h"), (None, text, "h"), (None, "Read more here\n" + words(2, 20), "h"), (None, text, "h")]
    got = line_frequency.frequent_lines(spark, frame(spark, rows), max_documents=2).collect()
    assert sorted((str(r.doc_id), r.n_removed_words) for r in got) == [("-1", 3), ("None", 3), ("None", 3), ("None", 3)]  # -1 and two texts: three documents
    assert all(r.n_removed_words == 0 for r in line_frequency.frequent_lines(spark, frame(spark, rows), max_documents=3).collect())


def place(spark, rows, **k):
    return sharding.place(spark, frame(spark, rows), **k).collect()


def test_sharding(spark):
    rows = [(i, words(i % 900, 5 + i % 60), "s") for i in range(3000)] + [(10_000 + i, "the same text " * 9, "s") for i in range(1500)]
    rows += [(None, None, "s"), (None, "", None), (20_000, "long " * 3000, "s"), (20_001, "x", "s"), (20_001, "x", "s")]
    got = place(spark, rows, samples=8)
    assert len(got) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 16
    assert set(sizes) == set(range(16)) and all(abs(s - mean) <= 15001 + 0.02 * mean for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where, weight = defaultdict(set), defaultdict(int)
    for r in got:
        where[r.text_crc32].add(r.shard)
        weight[r.text_crc32] += r.size
    assert all(len(s) == 1 for k, s in where.items() if weight[k] <= mean / 2)  # groups of equal texts are not cut
    assert place(spark, []) == []
    assert [(r.size, r.shard, r.slot) for r in place(spark, [(1, None, None)])] == [(1, 8, 0)]


def test_groups_are_dealt_whole(spark):
    rows = [(i, words(g, 6 + g % 7), "s") for g in range(40) for i in range(g * 100, g * 100 + 10 + g)]
    rows += [(None, "", None)] * 500 + [(None, words(99, 30), "s")] * 700 + [(9000 + i, words(1000 + i, 8), "s") for i in range(900)]
    got = place(spark, rows, samples=8, oversample=4)
    sizes, where, weight, slots = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
        weight[r.text_crc32] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 16
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 0.03 * mean + 200
    assert all(len(s) == 1 for k, s in where.items() if weight[k] <= 0.9 * mean)
    assert max(len(s) for s in where.values()) > 1  # 700 copies are more than a shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_large_copies_end(spark):
    rows = [(i, words(7, 400), "s") for i in range(3)] + [(10 + i, words(50 + i, 6), "s") for i in range(300)]
    got = place(spark, rows)
    assert len(got) == 303 and sorted(r.slot for r in got if r.shard == 3) == list(range(sum(r.shard == 3 for r in got)))
    assert len(place(spark, [(i, words(7, 400), "s") for i in range(2)])) == 2


def test_deal_against_plain():
    placed, room = sharding.deal([(1, 50), (2, 30), (3, 30), (4, 120), (5, 20)], 2, 200)
    assert placed == {1: 0, 2: 1, 3: 1, 5: 0} and room == [30, 40]


def test_mixing_spreads_rows_without_ids_and_skips_what_does_not_fit(spark):
    rows = [(None, words(i, 10), "s") for i in range(200)] + [(1, words(0, 500), "s")] + [(2 + i, words(i, 10), "t") for i in range(5000)]
    got = mixing.mix(spark, frame(spark, rows), entropy=0.2, max_epochs=4.0, budget=0.5, block_tokens=100).collect()
    assert len({r.block for r in got if r.doc_id is None}) > 5
    tokens = defaultdict(int)
    for r in got:
        tokens[r.source] += r.tokens
    weight = {r.source: r.weight for r in got}
    for s, most in (("s", 500), ("t", 10)):  # what is left is less than the longest row
        assert -most < tokens[s] - weight[s] * 0.5 * (2500 + 50_000) <= 1


def test_carry(spark):
    got = sharding.place(spark, frame(spark, [(1, "a", "s")]), carry=("text", "size")).collect()
    assert got[0].text == "a"


@pytest.mark.parametrize("block", [40, 100_000])
def test_mixing(spark, block):
    rows = [(i, words(i, 10), "big") for i in range(300)] + [(1000 + i, words(i, 10), "small") for i in range(30)] + [(2000 + i, words(i, 10), "tiny") for i in range(3)]
    rows += [(3000, None, None), (3001, "", "none")]
    got = mixing.mix(spark, frame(spark, rows), entropy=0.9, max_epochs=4.0, block_tokens=block, carry=("text",)).collect()
    tokens, times, weight = defaultdict(int), defaultdict(int), {}
    for r in got:
        tokens[r.source] += r.tokens
        times[r.doc_id] += 1
        weight[r.source] = r.weight
    total = 3330
    for s, n in (("big", 3000), ("small", 300), ("tiny", 30)):
        assert weight[s] * total - 10 <= tokens[s] <= round(weight[s] * total) <= 4 * n + 1
    assert abs(weight["tiny"] * total - 120) < 0.01  # the repetition limit holds the exponent
    assert times[3000] == times[3001] == 1 and weight["none"] == 0
    assert mixing.mix(spark, frame(spark, [])).count() == 0
    alone = mixing.mix(spark, frame(spark, rows[:5])).collect()
    assert len(alone) == 5 and alone[0].weight == 1.0
