"""Chat segments, the prefix trie and hard negatives against brute force on small rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat, common, negatives, trie

TURNS = "conv_id long, turn long, role string, text string, `walk part` int, name string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS)


def random_turns(seed, n=200, convs=12):
    rnd = random.Random(seed)
    pick = lambda xs: rnd.choice(xs)
    texts = ["", None, "a", "<|", "<\\|", "<|im_end|>", "a<\\\\|b", "<<|", "|im_start|>", "é\n%0A", "<|im_end|>\n<|im_start|>user\nx"]
    return [(pick([None, -3, *range(convs)]), pick([None, *range(6)]), pick(["user", "assistant", "tool", "system", None, "%0A", "a\nb", "<|x"]), pick(texts)) for _ in range(n)]


def in_order(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda v: (v[0], v[1].encode(), v[2].encode()))] for c, v in convs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_round_trip(spark, seed):
    rows = random_turns(seed)
    found = {r.conv_id: r for r in chat.digests(chat.segments(turns_of(spark, rows))).collect()}
    convs = in_order(rows)
    assert found.keys() == convs.keys()
    for c, turns in convs.items():
        r, state = found[c], "start"
        for role, _ in turns:
            state = chat.CHAT.moves.get(state, {}).get(role, "none")
        learnt = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.last_state) == (len(turns), len(learnt), state)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    text = chat.segments(turns_of(spark, rows)).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r.conv_id: r.n for r in text} == {c: r.formatted_chars for c, r in found.items()}
    assert chat.segments(turns_of(spark, [])).count() == 0


def test_chat_template_is_declared(spark):
    own = chat.Template(open="<|turn|>", close="<|over|>", learnt=("bot", "user"), ends=("bot",), moves={"begin": {"*": "bot"}, "bot": {"bot": "bot"}})
    rows = turns_of(spark, [(1, 0, "user", "<|over|>"), (1, 1, "bot", "b")])
    parts = chat.segments(rows, own).orderBy("turn_no", "segment_no").collect()
    assert [(p.text, p.loss) for p in parts] == [("<|turn|>user\n", False), ("<\\|over|>", True), ("<|over|>", False), ("<|turn|>bot\n", False), ("b", True), ("<|over|>", False)]
    assert parts[-1].state == "bot" and chat.digests(chat.segments(rows, own), own).first().loss_chars == 9
    with pytest.raises(ValueError):
        chat.Template(moves={"a": {"x": "b"}})
    with pytest.raises(ValueError):
        chat.Template(open="[turn]")


def test_walk_goes_on_over_tasks(spark):
    """A key with most rows lies in many tasks; places and states are those of one walk over it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(3000).select(F.when(F.col("id") % 10 < 8, F.lit(None)).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("n"))
        moves = [[1, 2, 0], [0, 0, 1]]  # of a machine with three states
        out = common.walked(rows.repartition(7), "k", ["n"], moves, (F.col("n") % 7 == 0).cast("int"))
        assert out.groupBy(F.spark_partition_id()).count().count() > 1
        found = sorted((r.k is not None, r.k or 0, r.n, r.place, r.state) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    places, states = collections.Counter(), collections.Counter()
    assert len(found) == 3000
    for there, k, n, place, state in found:
        key = (there, k)
        states[key] = moves[int(n % 7 == 0)][states[key]]
        assert (place, state) == (places[key], states[key])
        places[key] += 1


def brute_trie(convs):
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
                    sum(not any(r[: len(q)] == q and len(r) > len(q) for r in below) for q in below),
                    sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def test_trie_of_rebuilt_conversations(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "bb", None, "bb"])) for c in [0, 1, 2, 3, 5, 8, 50, 99, 100, 101, 205, -1, -100, None] for t in [*range(rnd.randrange(1, 9)), None]]
    rows += [(7, 1, "user", "a")] * 3
    convs = in_order(rows)
    convs.pop(None)
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = convs.get(base, [])[:h] + turns[h:]
    assert found_trie(trie.prefix_trie(*trie.rebuilt(trie.turns_of(turns_of(spark, rows))))) == brute_trie(whole)
    assert trie.prefix_trie(*trie.rebuilt(trie.turns_of(turns_of(spark, [])))).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 2, 5, 8, 9])
def test_trie_of_any_depth(spark, depth):
    rnd = random.Random(depth)
    convs = {c: [("u", rnd.choice("ab")) for _ in range(rnd.randrange(depth + 1))] for c in range(40)} | {40: [("u", "a")] * depth, 41: [("u", "a")] * depth}
    places = spark.createDataFrame([(c, d + 1, bytes(x, "ascii") * 32, len(x)) for c, turns in convs.items() for d, (_, x) in enumerate(turns)], "conv long, d long, name binary, chars long")
    assert found_trie(trie.prefix_trie(spark.createDataFrame([(c,) for c in convs], "conv long"), places)) == brute_trie(convs)


def brute_negatives(rows, every=50, low=50, high=95):
    rows = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(rows):
        if i % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j, z) for b, (j, w, z) in enumerate(rows) if a != b)
        for s, j, _ in [x for x in scores if x[2] == y][:5]:
            fits = [(n, k) for n, k, z in scores if z != y and low * -s <= 100 * -n <= high * -s]
            out += [(i, j, r, k, -s, -n) for r, (n, k) in enumerate(fits[:3], 1)]
    return sorted(out)


def found_negatives(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, label int, uid int, g string"


@pytest.mark.parametrize("scale, width", [(0.3, 6), (40.0, 3), (0.01, 8)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale, width):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width) * scale], int(rng.integers(3))) for i in range(-50, 300)]
    rows += [rows[100], rows[100], (400, rows[3][1], 1), (450, rows[3][1], 1), (401, [1.0], 2), (None, rows[0][1], 1), (402, None, 1), (403, [1.0, None], 1), (404, [float("nan")], 1), (405, [float("inf")], 0), (406, rows[5][1], None), (407, [], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    want = brute_negatives(rows)
    assert want and found_negatives(negatives.hard_negatives(df)) == want


def test_hard_negatives_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 1, 1, "x"), (51, [1.0], 1, 1, "x")], VECTORS)
    assert negatives.hard_negatives(alone).count() == 0  # no other label
    huge = spark.createDataFrame([(50, [3e30], 1, 1, "x"), (51, [3e30], 2, 1, "x")], VECTORS)
    with pytest.raises(ValueError):
        negatives.hard_negatives(huge)


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for size, width in ((2**7, 3000), (2**20, 50)):
        a, b = rng.integers(-size, size, (7, width)), rng.integers(-size, size, (9, width))
        a[0], b[0] = -size, size
        primes = negatives.primes_for(int(size) ** 2 * width)
        got = negatives.product([negatives.residues(a.astype(float), p) for p in primes], [negatives.residues(b.astype(float), p) for p in primes], primes)
        assert (got == a @ b.T).all()
