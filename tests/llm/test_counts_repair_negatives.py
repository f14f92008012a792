"""Token counts, conversation repair and hard negatives against brute force and on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from reportlens.llm import conversations, hard_negatives, queries, token_counts, tokens

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", " \t\n ", "x" * 300_000, "The same text, twice.\nThe same text, twice.", "é   b\n\n c\x1cd <|endoftext|> don't", "word " * 3000]


# Token counts

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = tokens.tokenizer_path(name)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(list("aZé ß.,'\n\t<|>  ́Σİ9中") + [" the", "<|endoftext|>"]) for _ in range(80)) for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no key", 2), (3, "key again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(token_counts.count_tokens(docs, path).collect(), key=str)
    if name.endswith("json"):
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(path)
        size = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    else:
        import sentencepiece
        whole = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(whole.encode(t or ""))
    want = [(i, len((t or "").encode()), size(t), size(t) > 512) for i, t, _ in rows]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(got[0].__class__(doc_id=r[0], n_bytes=r[1], n_tokens=r[2], over_limit=r[3])))
    assert token_counts.count_tokens(docs.where("false"), path).count() == 0


def test_table_of_lengths():
    pieces = [f" w{i}" for i in range(3000)] + ["", "z" * 15, "é" * 7]
    raw = [p.encode() for p in pieces[:3000] + pieces[3001:]]
    sizes = np.array([len(x) for x in raw])
    low, high = token_counts.packed(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    table = token_counts.Lengths.of(low, high, np.arange(len(raw)).astype(np.uint16))
    assert table.find(low, high).tolist() == list(range(len(raw)))
    other = [b" w3000", b"z" * 16, b"z" * 14, b"w1"]
    sizes = np.array([len(x) for x in other])
    assert set(table.find(*token_counts.packed(np.frombuffer(b"".join(other), np.uint8), np.cumsum(sizes) - sizes, sizes))) == {-1}
    none = token_counts.Lengths.of(low[:0], high[:0], np.zeros(0, np.uint16))
    assert set(none.find(low, high)) == {-1}


def test_no_shuffle_of_pieces(spark):
    plan = token_counts.count_tokens(spark.read.parquet(f"{SF}/documents.parquet"), tokens.tokenizer_path("byte_bpe_50k.json"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_full_memory_changes_nothing(monkeypatch):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    texts = pa.array([f"odd{i} words{i * 7} again{i % 3}" for i in range(500)])
    none = token_counts.Lengths.of(*(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.uint16))
    want = token_counts.counted(texts, path, none).tolist()
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    assert [n for i in range(0, 500, 20) for n in token_counts.counted(texts.slice(i, 20), path, none).tolist()] == want


# Conversation repair

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Dijkstra over (message, state, audit): the least cost, then the least audit."""
    word = re.compile(r"[^\x20\x09-\x0D]")
    seen, faults = set(), []
    for _, _, role, text in rows:
        found = word.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "cut" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for name in ("user", "assistant"):
            to = step.get((state, name[0]))
            if to:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, kept + (f"{name}:",)))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "cut" else 0
                if step.get((state, role[:1])):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], kept + (f"{role}:{text}",)))
                for name in ("user", "assistant"):
                    to = step.get((state, name[0]))
                    if to:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, kept + (f"{name}:{text}",)))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("cut"), illegal, cost, audit, digest


def by_conversation(rows, spark):
    """Messages of each conversation in the operator's order."""
    keyed = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "i int, text string").select("i", F.xxhash64("text").alias("h")).collect()
    hashes = {r["i"]: r["h"] for r in keyed}
    out = {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][1] is not None, x[1][1] or 0, x[1][2].encode(), hashes[x[0]])):
        out.setdefault(r[0], []).append(r)
    return out


def random_conversations(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 3, 4, 6, 9, 30])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                             rng.choice(["Yes.", "No?", "cut", "", " \n", None, f"own {rng.random()}.", f"own {rng.random()}", "é!\x0b"])))
    return rows


@pytest.mark.parametrize("block_rows", [3, 40, 8192])
def test_repair_is_cheapest(spark, block_rows):
    rows = random_conversations(random.Random(block_rows), 150)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    found = conversations.repair_conversations(conversations.damaged(frame), block_rows=block_rows).collect()
    damaged = by_conversation(plain_damage(rows), spark)
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        assert tuple(r)[1:] == plain_repair(damaged.get(r["conv_id"], [])), r["conv_id"]


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = by_conversation(plain_damage(rows), spark)
    found = queries.op12_conversation_repair(spark, "/root/testdata/sf0.01").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == {c: plain_repair(damaged.get(c, [])) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("fixups", [0, 1, 30])
def test_segments_settle(spark, fixups):
    """Messages without end marks pass a vector on, so guesses are only mended by many passes or by doubling."""
    repair, rng = conversations.Repair(), random.Random(fixups)
    rows, want = [], {}
    for conv in range(12):
        roles = [rng.choice(["user", "assistant", "system"]) for _ in range(rng.choice([1, 5, 60]))]
        texts = [f"{conv} {i}" + ("." if rng.random() < (0.1 if conv % 2 else 0.8) else "") for i in range(len(roles))]
        want[conv] = plain_repair([(conv, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))])
        rows += [(conv, i, r, t, 1) for i, (r, t) in enumerate(zip(roles, texts))]
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, copies int")
    segments = conversations.first_pass(frame, repair, 4, 1 << 20).where("seg is not null")
    assert segments.count() > 20
    original = conversations.settled
    conversations.settled = lambda s, r: original(s, r, fixups)
    try:
        found = conversations.stitched(segments, repair).collect()
    finally:
        conversations.settled = original
    assert found and all(tuple(r)[1:] == want[r["conv"]] for r in found)


def test_lanes_give_the_vectors_of_one_run():
    rng, repair = np.random.default_rng(5), conversations.Repair()
    for cut in (0.0, 0.5, 1.0):
        codes = 2 * rng.integers(0, 4, 500) + (rng.random(500) < cut)
        last = rng.random(500) < 0.01
        one, head = repair.backward(codes, last, repair.end, lane=500)
        for lane in (1, 7, 64):
            many, other = repair.backward(codes, last, repair.end, lane=lane)
            assert (many == one).all() and (other == head).all()
        m = repair.response(codes)
        way = (m + repair.end).min(axis=1)
        assert (way - way.min() == repair.backward(codes, np.zeros(500, bool), repair.end)[1]).all()


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.repair_conversations(conversations.damaged(empty)).count() == 0
    gone = spark.createDataFrame([("k", 1, "user", "x", 0)], "conv string, turn long, role string, text string, copies int")
    assert tuple(conversations.repair_conversations(gone).first()) == ("k", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# Hard negatives

def test_strassen():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (33, 64, 70), (70, 35, 129), (128, 64, 128), (0, 5, 7)]:
        a, b = rng.integers(-1 << 20, 1 << 20, (m, k)), rng.integers(-1 << 20, 1 << 20, (k, n))
        for leaf in (4, 32):
            assert (hard_negatives.strassen(a, b, leaf) == np.einsum("ik,kj->ij", a, b)).all()
    a = rng.integers(-1 << 40, 1 << 40, (40, 40))
    assert (hard_negatives.strassen(a, np.eye(40, dtype=np.int64), 1) == a).all()


def plain_negatives(rows):
    data = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        data[key] = min(data.get(key, (label, v)), (label, v))
    whole = {k: (lab, [int(np.floor(256 * x)) for x in v]) for k, (lab, v) in data.items()}
    out = []
    for a in sorted(k for k in whole if k % 50 == 0):
        scores = {k: sum(x * y for x, y in zip(whole[a][1], v)) for k, (_, v) in whole.items() if k != a}
        alike = sorted((-s, k) for k, s in scores.items() if whole[k][0] == whole[a][0])[:5]
        for s, p in alike:
            other = sorted((-t, k) for k, t in scores.items() if whole[k][0] != whole[a][0] and 50 * -s <= 100 * t <= 95 * -s)[:3]
            out += [(a, p, r + 1, k, -s, -t) for r, (t, k) in enumerate(other)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [7, 100, 4096])
def test_hard_negatives(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [(int(k), int(rng.choice([0, 0, 0, 1, 2, 9])), [float(x) for x in np.round(rng.normal(size=5), 1)]) for k in range(-20, 400)]
    rows += [(k + 1000, 0, [0.5, 0.5, 0.0, 0.0, 0.0]) for k in range(60)]                       # copies and ties
    rows += [(50, 3, [9.0] * 5), (None, 1, [1.0] * 5), (401, None, [1.0] * 5), (402, 1, None), (403, 1, [1.0, None]), (404, 1, [float("nan")]),
             (405, 1, [float("inf")]), (406, 1, []), (407, 1, [3.0]), (450, 2, [1.0] * 7)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<double>, rank int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mine = lambda df: hard_negatives.mine(df, "vec_id", "embedding", label, F.col("id") % 50 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in mine(frame).collect()) == plain_negatives(rows)
    assert mine(frame.where("false")).count() == 0
    assert mine(frame.where("vec_id = 50")).count() == 0
