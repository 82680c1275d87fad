"""Window packing, filter audit and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from webloom.llm import filter_audit, importance, window_packing

SCHEMA = "doc_id long, text string, lang string, score double, rank string, part string, Step int, digest string, n_features int"
WORDS = "The quick brown fox jumps over a lazy dog; Été über 東京 x9 A1 TWO three-four. No! yes? 3.14 $5 &c".split()


def made_rows():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", " \n\t", "one", "A B C D", "x" * 9000, say(60_000), "\x00a\x7fb\x1cc", "word " * 250, "É" * 70 + " " + "z" * 64 + " " + "q" * 65]
    rows = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts)]
    rows += [(100 + i, say(rng.choice([5, 19, 20, 21, 199, 200, 900])), rng.choice(["en", "", None])) for i in range(80)]
    rows += [(300 + i, rows[12 + i % 3][1], "fr") for i in range(20)] + [(None, rows[12][1], "en"), (None, "no id", None)]
    rows += [rows[15], rows[15], (rows[16][0], "the same id", "en"), (50, rows[13][1], "en")]
    return [(i, t, lang, 0.5, "r", "p", 1, "d", 2) for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(100, 170)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (301, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain(frame):
    return [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in frame.select("doc_id", "text", "lang").collect()]


# windows


def padding(n, capacity):
    return 0 if n & (n - 1) == 0 else capacity - n


def least_cost(places, costs, prices):
    """All cuts tried: quadratic."""
    at, least = [0, *places], [0]
    for j in range(1, len(at)):
        reach = [i for i in range(j) if at[j] - at[i] <= prices.capacity]
        least.append(min(least[i] + padding(at[j] - at[i], prices.capacity) for i in reach) + costs[j - 1] + prices.window)
    return least[-1]


def test_best_cuts_cost_the_least():
    rng = random.Random(3)
    for _ in range(300):
        prices = window_packing.Prices(rng.choice([4, 16, 37, 64]), rng.randint(0, 5), rng.randint(0, 9), rng.choice([0, 1, 7]))
        gaps = [rng.randint(1, prices.capacity if rng.random() < 0.2 else 1 + prices.capacity // 4) for _ in range(rng.randint(1, 60))]
        places = np.cumsum(gaps)
        costs = np.array([rng.choice([0, prices.sentence, prices.inside]) for _ in gaps], np.int32)
        cuts = window_packing.best_cuts(places, costs, prices)
        price = dict(zip(places.tolist(), costs.tolist()))
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == places[-1] and sizes.max() <= prices.capacity
        cost = sum(padding(int(n), prices.capacity) for n in sizes) + sum(price[c] + prices.window for c in cuts)
        assert cost == least_cost(places.tolist(), costs.tolist(), prices)


def test_sentences_end_where_they_do():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tables = window_packing.sentence_tables(tokenizer)
    text = 'He paid 3.14 for it. "Why?" she asked\nNobody knew'
    ids = np.array([*tokenizer.encode(text).ids, 1], np.uint32)
    places, costs = window_packing.cut_places(ids, np.array([len(ids)]), tables, window_packing.Prices())
    pieces = [tokenizer.decode(ids[a:b].tolist()) for a, b in zip([0, *places[:-1]], places)]
    assert pieces[:3] == ["He paid 3.14 for it.", ' "Why?"', " she asked\n"] and costs[-1] == 0 and (costs[:-1] == 4).all()


@pytest.mark.parametrize("block_ids", [500, 1_000_000])
def test_windows_hold_every_id_once(docs, block_ids):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = window_packing.window_packing(docs, block_ids=block_ids).collect()
    wanted = Counter()
    streams = [[*e.ids, 1] for e in tokenizer.encode_batch([t for _, t, _ in plain(docs)], add_special_tokens=False)]
    known = {}
    for (doc_id, _, _), ids in zip(plain(docs), streams):
        known.setdefault(doc_id, []).append(np.array(ids, "<u4"))
        wanted[doc_id] += len(ids)
    got = Counter()
    for r in rows:
        fits = [ids for ids in known[r["doc_id"]] if len(ids) == r["doc_tokens"]]
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in fits)
        got[r["doc_id"]] += r["length"]
    assert got == wanted
    once = [r for r in rows if r["doc_id"] is not None and len(known[r["doc_id"]]) == 1]
    for doc_id in {r["doc_id"] for r in once}:
        spans = sorted((r["start"], r["length"], r["sequence_id"]) for r in once if r["doc_id"] == doc_id)
        assert spans[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] + 1 == b[2] for a, b in zip(spans, spans[1:]))
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        sizes.append(sum(spans[-1]))
    assert max(sizes) <= 2048
    assert sum(padding(n, 2048) for n in sizes) < 0.02 * sum(sizes)


def test_windows_of_little_and_nothing(spark, docs):
    assert window_packing.window_packing(docs.limit(0)).count() == 0
    (r,) = window_packing.window_packing(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert tuple(r)[:3] == (None, 0, 1) and r["ids_crc32"] == zlib.crc32((1).to_bytes(4, "little"))


# filters


def audited(rows, labels):
    """Every order applied to every document."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails = []
    for i, t, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        f |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((part, {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                own = [x for x in fails if x[0] == part and f in x[1]]
                out[part, order, step] = [len(left), len(gone), len(own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] += len(gone)
    return {k: tuple([*v, shapley[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def test_filter_audit(spark, docs, labels):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    assert got == audited(plain(docs), labels.collect())
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.filter_audit(docs, labels.limit(0)).collect()
    assert len(bare) == len(got) and not any(r["good_lost"] or r["toxic_lost"] for r in bare)


# draws


def resampled(rows, target, percent):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    buckets = lambda t: [zlib.crc32(w) % 10_000 for w in words(t)]
    s, t = Counter(b for _, x, _ in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x or ""))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, x, _ in rows:
        found = buckets(x)
        weight = sum(map(gain, found)) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return out


ORDER = lambda r: tuple((v is None, v or 0) for v in r)


@pytest.mark.parametrize("percent", [10, 55, 100])
def test_importance_resampling(spark, docs, percent):
    target = [None, "", "The quick Ü fox", "über " * 40, "東京 x9"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = sorted((tuple(r) for r in importance.importance_resample(docs, frame, percent=percent).collect()), key=ORDER)
    assert got == sorted((tuple(r) for r in resampled(plain(docs), target, percent)), key=ORDER)
    assert any(r[4] for r in got)


def test_draw_without_documents_or_target(spark, docs):
    frame = spark.createDataFrame([], "item_id int, text string")
    assert importance.importance_resample(docs.limit(0), frame).count() == 0
    got = sorted((tuple(r) for r in importance.importance_resample(docs, frame).collect()), key=ORDER)
    assert got == sorted((tuple(r) for r in resampled(plain(docs), [], 10)), key=ORDER)


def test_words_of_odd_buffers():
    rng = random.Random(9)
    texts = ["".join(rng.choice("aZ9 é東\x00-_\n{`@") for _ in range(rng.choice([0, 1, 2, 30, 200]))) for _ in range(400)] + [None, "a" * 3000, ""]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["skip", *texts]).slice(1)):
        found = [(b.tolist(), n.tolist()) for b, n in importance.word_buckets(column, 1 << 31)]
        words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
        assert sum((n for _, n in found), []) == [len(w) for w in words]
        assert sum((b for b, _ in found), []) == [zlib.crc32(w) % (1 << 31) for ws in words for w in ws]
