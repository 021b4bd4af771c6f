"""Operators against brute force, on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import chat, common, decontaminate, exact, langid, mixing, neardup, quality, simhash, substring, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, owner int"


def rows(seed=5):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta.", "idiot"] + [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(60):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))
        t = f"{t}\n{passage} {t[:40]}" if i % 5 == 0 else t
        out.append(t)
    out += [out[3], out[3], out[4] + " x", None, "", " \n", "long " * 30_000, passage, passage.upper()]
    table = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "a"][i % 4], 1, "clash", "clash", 9) for i, t in enumerate(out)]
    return [*table, table[7], (500, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())

    def fp(text):
        words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {r[0]: fp(r[1]) for r in rows()}
    assert all(r.fp % (1 << 64) == want[r.id] for r in got)
    label = {i: i for i in want}
    for _ in want:
        label = {i: min(label[j] for j in want if (want[i] ^ want[j]).bit_count() <= 4) for i in want}
    assert all(r.component == label[r.id] for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(docs).count() == len(set(label.values()))


def test_simhash_hot_bucket(spark):
    rng = random.Random(2)
    fps = sorted({sum(1 << b for b in rng.sample(range(30), rng.randint(0, 3))) for _ in range(300)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for block, small in ((20_000, 16), (40, 16), (40, 2)):
        links = [(r.src, r.dst) for r in simhash.links(df, block=block, small=small).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        seen, todo = {fps[0]}, [fps[0]]
        near = {x: {b for a, b in links if a == x} | {a for a, b in links if b == x} for x in fps}
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert len(seen) == len(fps)


def near_groups(table, similarity=0.8):
    """Smallest ids of the groups, by brute force over the candidate rule, then over the link rule within its components."""
    fps = {}
    for i, t in table:
        f = tuple(int(w) for w in neardup.wide_fingerprint(t))
        fps[f] = min(i, fps.get(f, i))
    keys, n = list(fps), neardup.INDEXED
    boxes = {f: [[w >> 9 * b & 511 for b in range(7)] for w in f[:n]] for f in keys}
    loose, most = neardup.budget(similarity, n, 1.5), neardup.budget(similarity, spread=0.5)

    def bits(f, g):
        return sum((x ^ y).bit_count() for x, y in zip(f, g))

    def components(linked):
        parent = {f: f for f in keys}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for at, f in enumerate(keys):
            for g in keys[:at]:
                if linked(f, g):
                    a, b = sorted((root(f), root(g)), key=fps.get)
                    parent[b] = a
        return {f: root(f) for f in keys}

    rough = components(lambda f, g: bits(f[:n], g[:n]) <= loose and any(sum(x == y for x, y in zip(p, q)) >= 2 for p, q in zip(boxes[f], boxes[g])))
    return {fps[r] for r in components(lambda f, g: rough[f] == rough[g] and bits(f, g) <= most).values()}


def test_near_duplicates_at_similarity(spark, docs):
    rng = random.Random(2)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    table = [(r[0], r[1]) for r in rows()] + [(1000, " ".join(base)), (1001, " ".join(base[:140])), (1002, " ".join(base[:70]))]
    more = docs.unionByName(spark.createDataFrame([(*r, "en", "a", 1, "c", "c", 1) for r in table[-3:]] + [(None, "no id", "en", "a", 1, "c", "c", 1)], SCHEMA))
    out = neardup.one_of_each(more)
    assert out.columns == more.columns
    got = [r.doc_id for r in out.collect()]
    assert got.count(None) == 1 and 1001 not in got and {1000, 1002} <= set(got)
    assert sorted(i for i in got if i is not None) == sorted(near_groups(table))
    assert neardup.one_of_each(empty(spark)).count() == 0


def test_near_duplicates_hot_bucket(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(900)}" for _ in range(200)]
    table = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        table.append((i, " ".join(words)))
    fps = neardup.wide_fingerprints(spark.createDataFrame(table, "doc_id long, text string"), "doc_id", "text", 5).groupBy(*(f"f{k}" for k in range(neardup.WORDS))).agg(F.min("id").alias("id"))
    whole, dealt = (simhash.connected_components(neardup.links(fps, 0.8, **about)) for about in ({}, {"block": 20}))
    assert sorted(whole.collect()) == sorted(dealt.collect())
    kept = {r.id for r in fps.select("id").collect()} - {r.node for r in whole.where("node <> root").collect()}
    assert kept == near_groups(table)


def test_ring_loses_no_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, (4000, neardup.INDEXED), np.uint64, endpoint=False)
    x &= rng.integers(0, 2**64, x.shape, np.uint64, endpoint=False) & rng.integers(0, 2**64, x.shape, np.uint64, endpoint=False)
    plain = np.flatnonzero(np.bitwise_count(x).sum(1) <= 32)
    assert len(plain) > 1000 and set(neardup.ring_linked(x, 32)) == set(plain)


def test_langid(spark, docs):
    model = langid.fit(docs)
    got = {r.id: r for r in langid.predict(docs, model).collect()}
    assert got[63].lang_pred == "und" and got[64].lang_pred == "und" and got[500].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and {r.lang_pred for r in got.values()} <= {"en", "fr", "und"}
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.predict(docs, langid.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", r"<\/turn> </turn>\ ", "### User: ### Tool: x", "<|image:0.1|> <\\\\|audio:", None, "", "a\nb", "😀" * 5, "### @41: z"]
    data = [(i % 3 - 1, i, ["user", "assistant", "odd: role</turn>", None][i % 4], t) for i, t in enumerate(texts)] + [(None, None, None, None), (0, 1, "user", "tie"), (0, 1, "user", "tie")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    for conv in {d[0] for d in data}:
        own = sorted(((d[1] if d[1] is not None else -1, d[2] or "", d[3] or "") for d in data if d[0] == conv), key=lambda x: x[:2])
        assert sorted((t.role, t.text) for t in got[conv].turns) == sorted(x[1:] for x in own)
        assert sorted(got[conv].loss_text) == sorted("".join(x[2] for x in own if x[1] == "assistant"))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = [("text", "see </turn>", None, None), ("image", None, "u1", None), ("audio", None, "u2", 7), ("what", None, "u3", None)]
    df = spark.createDataFrame([(1, 0, "user", part)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "### User: see <\\/turn><|image:0.1|><|audio:0.2|><|other:0.3|></turn>\n"
    assert [(a.placeholder, a.uri, a.tokens) for a in r.attachments] == [("<|image:0.1|>", "u1", 256), ("<|audio:0.2|>", "u2", 7), ("<|other:0.3|>", "u3", 1)]


def test_chat_parts_round_trip(spark):
    text = lambda t: ("text", t, None, None)
    image = ("image", "alt <|image:0.0|>", "u", 3)
    cases = [
        [text("<"), text(""), text("/turn>\n### User: injected")], [text("##"), text("# User: x <|"), text("image:0.1|>")], [image, text("a"), image], [text("<"), image, text("/turn>"), ("audio", None, None, None)],
        [], [(None, None, None, None)], [text("### Us"), ("what", None, "u", None), text("er: "), text("</tu"), text("rn>")],
    ]
    data = [(1, turn, "user", p, "clash") for p in cases for turn in (3, 3, None, -1)]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {chat.PARTS}, attachments string")
    formatted = chat.format_conversations(df)
    r = chat.read_conversations(formatted).first()
    f = formatted.first()
    marks = [a.placeholder for a in f.attachments]
    assert len(set(marks)) == len(marks) == 4 * 5 and all(f.formatted.count(m) == 1 for m in marks) and len(r.turns) == len(data)

    def merged(parts):
        out = []
        for kind, t, uri, n in parts:
            kind = kind or "text"
            if kind == "text" and out and out[-1][0] == "text":
                out[-1][1] += t or ""
            else:
                out.append(["text", t or "", None, None] if kind == "text" else ["other" if kind == "what" else kind, t, uri, n or {"image": 256, "audio": 100, "what": 1}[kind]])
        return [tuple(x) for x in out if x[0] != "text" or x[1]]

    assert Counter(tuple(map(tuple, t.parts)) for t in r.turns) == Counter(tuple(merged(d[3])) for d in data)
    assert {t.role for t in r.turns} == {"user"} and f.formatted.count("</turn>\n") == len(data)


def test_substring(spark, docs):
    table = rows()
    words = [(r[0], (r[1] or "").encode().split()) for r in table]
    n = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in substring.repeated_passages(docs).collect())
    assert got == sorted(want) and sum(x[2] for x in want) > 500
    assert substring.repeated_passages(empty(spark)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    total = sum(len((r[1] or "").split()) for r in rows())
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s and abs(x - t) <= 30_000 for x, t, s in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mixed_rows(docs).count() == sum(r.epochs for r in got) and mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0


def test_decontamination(spark, docs):
    table = rows()
    items = [(1, table[0][1]), (2, "Alpha, BETA"), (3, None), (4, "!!"), (None, "w1"), (5, table[67][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = decontaminate.normal_words
    found = {r.id: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t in {(r[0], r[1]) for r in table}:
        w, hit, named = split(t), set(), set()
        for item, text in items:
            b = split(text)
            for k in range(max(1, len(b) - 12) if b and item is not None else 0):
                win = b[k : k + 13]
                at = [p for p in range(len(w) - len(win) + 1) if w[p : p + len(win)] == win]
                hit |= {p + o for p in at for o in range(len(win))}
                named |= {str(item)} if at else set()
        r = found[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w))
        assert sum(len(split((t or "")[s.start : s.end])) for s in r.spans) == r.n_hit
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not found[r[0]].contaminated for r in table)
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, bench, max_bytes=10)


def test_decontamination_in_parts(spark, docs):
    table = rows()
    bench = spark.createDataFrame([(i, table[i][1]) for i in range(12)] + [(12, None), (13, "one odd item")], "item_id long, text string")
    parts = decontaminate.item_parts(bench, "item_id", "text", 1500)
    assert len(parts) > 2 and sorted(r.item for p in parts for r in p.collect()) == sorted(str(i) for i in range(14))
    whole, split = (sorted(decontaminate.contamination(docs, bench, **about).collect(), key=str) for about in ({}, {"max_bytes": 1500}))
    assert whole == split and sum(r.n_hit for r in whole) > 100
    assert decontaminate.decontaminated(docs, bench, max_bytes=1500).count() == sum(not r.contaminated for r in whole)
    assert decontaminate.united([(5, 9), (0, 2), (2, 3), (6, 7)]) == [(0, 3), (5, 9)]


def test_hot_keys_and_hubs(spark):
    data = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    table = data.groupBy("k").agg(F.count("*").alias("many"), F.min("id").alias("least"))
    for about in ({}, {"hot": 10, "most": 50}):
        assert sorted((r.id, r.least) for r in common.salted_join(data, table, ["k"], "many", "id", **about).collect()) == [(i, 1 if i % 3 else i) for i in range(300)]
    edges = [(0, i) for i in range(1, 200)] + [(500 + i, 501 + i) for i in range(20)] + [(199, 300), (7, 7), (1, 0)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = {i: 0 for i in [*range(200), 300]} | {500 + i: 500 for i in range(21)}
    for hub in (100_000, 5):
        assert {r.node: r.root for r in simhash.connected_components(df, hub=hub).collect()} == want


def test_toxicity_and_quality(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    data, marks = [], []
    for i in range(600):
        bad, low = i % 6 == 0, i % 4 == 0
        w = [rng.choice(base) for _ in range(40)]
        w = [x + "###" if low else x for x in w] + (["scum", "moron"] if bad else [])
        data.append((i, " ".join(w), None, None, None, "c", "c", 1))
        marks.append((i, 0 if low else 1, int(bad)))
    df = spark.createDataFrame([*data, (900, None, *[None] * 6), (901, "", *[None] * 6)], SCHEMA)
    labels = spark.createDataFrame([*marks, marks[0], (77_777, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df.where("doc_id < 400"), labels)
    got = {r.id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(t) for i, _, t in marks[400:]]) > 0.95
    out = quality.score(df, quality.fit(df.where("doc_id < 400"), labels))
    got = {r.doc_id: r.score for r in out.collect()}
    assert out.columns == [*df.columns, "score"] and np.mean([(got[i] >= 0.5) == bool(q) for i, q, _ in marks[400:]]) > 0.95
    assert quality.score(empty(spark), quality.fit(df, labels.limit(0))).count() == 0


def test_exact(spark, docs):
    same = Counter(r[1] or "" for r in rows())
    keep = {t: max(r[0] for r in rows() if (r[1] or "") == t) for t in same}
    text = {r[0]: r[1] or "" for r in rows()}
    got = exact.exact_duplicates(docs, capacity=2).collect()
    assert len(got) == len(rows())
    for r in got:
        t = text[r.id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep[t], same[t], r.id == keep[t], hashlib.sha256(t.encode()).hexdigest())
    assert exact.exact_duplicates(empty(spark)).count() == 0


def test_extendible_index_chains_collisions():
    index = exact.ExtendibleIndex(capacity=2)
    for k in range(40):
        index.add(k * 5, b"v%d" % k, k, 1)
    index.add(5, b"other", 99, 1)
    index.add(5, b"v1", 7, 2)
    entries = list(index.entries())
    assert index.depth > 3 and len(entries) == 41
    assert [(e[3], e[4], e[5], e[6]) for e in entries if e[2] == 5] == [(0, b"v1", 7, 3), (1, b"other", 99, 1)]
    assert all(e[2] & ((1 << e[0]) - 1) == e[1] for e in entries)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.default_tokenizer())
    table = sorted(((r[0], r[1] or "") for r in rows()))
    got = {(r.id, r.start): r for r in tokens.read_tokens(tokens.write_tokens(docs, tokens.default_tokenizer(), block=100, shard=700)).collect()}
    at = 0
    for i, t in table:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        r = got[i, at]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(table)
    e = tokens.encoder(tokens.default_tokenizer())
    for t in ["It's <|endoftext|> x", "É̀ Σς İ", "漢字 ok 12'll", "\x1ca\xa0b", ""]:
        assert e(t).tolist() == tk.encode(t, add_special_tokens=False).ids
    blob = tokens.write_shard([np.arange(250, dtype="<u4"), np.array([], "<u4"), np.array([70_000], "<u4")], block=100)
    assert tokens.read_block(blob, 1).tolist() == list(range(100, 200)) and [len(x) for x in tokens.read_shard(blob)] == [250, 0, 1]
    assert tokens.read_tokens(tokens.write_tokens(empty(spark), tokens.default_tokenizer())).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in kept.collect())


def toxicity_by_hand(counted, order=5, discount=2.0):
    """P(class, x, h) and the features of a text, by exact counts of (text, class) rows in dicts; Kneser-Ney written out."""

    def chars(t):
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        return " " * (order - 1) + "".join(x + " " for x in w), len(w)

    n, kinds = [Counter(), Counter()], set()
    for t, y in counted:
        s = chars(t)[0]
        for i in range(len(s) - order + 1):
            kinds.add(s[i : i + order])
            if y is not None:
                n[y][s[i : i + order]] += 1
    level = {order: kinds}
    count = {}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in level[k + 1])
        level[k] = set(count[k])
    after = {k: {} for k in range(1, order)}
    for k in range(1, order):
        for g, c in count[k].items():
            after[k].setdefault(g[:-1], []).append(c)
    total, alphabet = sum(count[1].values()), len(count[1])

    def shared(g):
        if not g:
            return 1 / (alphabet + 1)
        if g[:-1] not in after[len(g)]:
            return shared(g[1:])
        own = after[len(g)][g[:-1]]
        return max(count[len(g)][g] - 0.75, 0) / sum(own) + 0.75 * len(own) / sum(own) * shared(g[1:])

    context = [{}, {}]
    for c in (0, 1):
        for g, x in n[c].items():
            context[c].setdefault(g[:-1], []).append(x)

    def p(c, h, x):
        own = context[c].get(h)
        if own is None:
            return shared(h[1:] + x)
        share = sum(min(y, discount) for y in own) / sum(own)
        return max(n[c][h + x] - discount, 0) / sum(own) + share * shared(h[1:] + x)

    def features(t):
        s, words = chars(t)
        r, k = [0.0] * words, 0
        for i in range(order - 1, len(s)):
            h, x = s[i - order + 1 : i], s[i]
            r[k] += np.log(p(1, h, x)) - np.log(p(0, h, x))
            k += x == " "
        best = [max(sum(r[i : i + m]) for i in range(max(1, words - m + 1))) / m for m in (1, 3, 8)]
        return [1.0, sum(r) / words, *best, np.log1p(words) / 10] if words else [1.0, 0, 0, 0, 0, 0]

    return p, features, sorted(count[1]), context


def toxic_rows(seed, n=700):
    rng = random.Random(seed)
    part = ["th", "on", "ing", "er", "ba", "lu", "è", "ment"]
    table = []
    for i in range(n):
        w = ["".join(rng.choice(part) for _ in range(rng.randint(1, 3))) for _ in range(40)]
        bad = i % 5 == 0
        w += ["scum", "luxba" + rng.choice(part)] if bad else []
        rng.shuffle(w)
        table.append((i, " ".join(w).capitalize() + "!", int(bad) if i % 7 else None))
    return [*table, table[3], table[5]]


def test_toxicity_is_kneser_ney(spark):
    table = toxic_rows(8)
    fold = {i: zlib.crc32(str(i).encode()) // 4 % 4 for i, *_ in table}
    more = [(1000, None), (1001, "scum zzz"), (1002, ""), (1003, "12 !?"), (1004, "on " * 30_000), (1000, "again")]
    df = spark.createDataFrame([*[(i, t, "clash") for i, t, _ in table], *[(i, t, "clash") for i, t in more]], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, y, "clash") for i, _, y in table] + [(3, 0, "twice"), (99_999, 1, "none")], "doc_id long, toxic int, id string")
    model = toxicity.fit(df.where("doc_id < 700"), labels)
    counted = [(t, y) for i, t, y in table if fold[i] != 0 or y is None]
    p, features, alphabet, context = toxicity_by_hand(counted)
    for c in (0, 1):
        for h in sorted(context[c])[::40]:
            assert sum(p(c, h, x) for x in alphabet) < 1 < 1e-6 + sum(p(c, h, x) for x in alphabet) + 1 / (len(alphabet) + 1)
    got = Counter((r.id, round(r.score, 5)) for r in toxicity.score(df, model).collect())
    rows = [(i, t) for i, t, _ in table] + more
    assert sum(got.values()) == len(rows)
    want = {}
    for i, t in rows[:60] + more:
        z = model.weights @ features(t)
        want[i, t] = 1 / (1 + np.exp(-z))
        assert any(j == i and abs(s - want[i, t]) < 2e-4 for j, s in got), (i, want[i, t])
    assert want[1001, "scum zzz"] > 0.3 and toxicity.score(df.limit(0), model).count() == 0
    split = model._replace(most_entries=-(-model.terms.count() // 3))
    assert {r.id: r.score for r in toxicity.score(df.where("doc_id < 900"), split).collect()} == pytest.approx({r.id: r.score for r in toxicity.score(df.where("doc_id < 900"), model).collect()}, abs=1e-6)
    nothing = toxicity.fit(df.limit(0), labels.limit(0))
    assert [r.score < 0.5 for r in toxicity.score(df.limit(2), nothing).collect()] == [True] * 2


def test_toxicity_of_a_larger_corpus(spark):
    """Recall on toxic words does not fall when ordinary text with other words grows; few of the clean texts are called toxic."""
    table, rng = toxic_rows(9), random.Random(1)
    other = [(5000 + i, " ".join("".join(rng.choice(["ka", "po", "mi", "du", "ras"]) for _ in range(3)) for _ in range(60)), 0) for i in range(2800)]
    test = spark.createDataFrame([(i, t) for i, t, _ in toxic_rows(10)], "doc_id long, text string")
    truth = {i: i % 5 == 0 for i in range(700)}
    for extra in ([], other):
        df = spark.createDataFrame([*table, *extra], "doc_id long, text string, toxic int")
        got = {r.id: r.score >= 0.3 for r in toxicity.score(test, toxicity.fit(df, df)).collect()}
        assert np.mean([got[i] for i in got if truth[i]]) > 0.95 and np.mean([got[i] for i in got if not truth[i]]) < 0.05


def test_toxicity_counts_all_but_the_draw(spark):
    table = toxic_rows(9, 800)[:800]
    fold = {i: zlib.crc32(str(i).encode()) // 4 % 4 for i, *_ in table}
    size = Counter(y for i, _, y in table if fold[i] == 0)

    def calibrates(i, y):
        draw = xxhash.xxh64_intdigest(str(i).encode(), 42) % (1 << 30)
        return y is not None and fold[i] == 0 and draw < int(10 / size[y] * (1 << 30)) + 1

    df = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, toxic int"), calibrate_per_class=10)
    counted = [(t, y) for i, t, y in table if not calibrates(i, y)]
    assert 5 < len(table) - len(counted) < 50
    features = toxicity_by_hand(counted)[1]
    got = {r.id: r.score for r in toxicity.score(df, model).collect()}
    for i, t, _ in table[:40]:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.weights @ features(t)))), abs=2e-4)


def test_items_without_id(spark, tmp_path):
    import corpus_pipeline

    table = [(0, "one two three four"), (1, "one two"), (2, "five six"), (3, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(None, "Two three"), (7, "four"), (None, "six")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.op6_decontaminate(spark, str(tmp_path)).collect()}
    name = [hashlib.sha256(x).hexdigest() for x in (b"", b"7")]
    assert got == {0: (4, 3, 2, name[1], True), 1: (2, 0, 0, name[0], False), 2: (2, 1, 1, name[0], True), 3: (0, 0, 0, name[0], False)}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 3]


def quality_by_hand(text, model):
    """The machine's margin with every pair of features written out."""
    at, x = quality.features(text)
    w0, w, v = model[0], model[1].astype(np.float32).astype(float), model[2].astype(np.float32).astype(float)
    both = (v[at] @ v[at].T) * np.outer(x, x)
    return 1 / (1 + np.exp(-(w0 + x @ w[at] + np.triu(both, 1).sum())))


def mixed_by_hand(table):
    """Epochs of (id, source, text) rows with different ids: targets by filling up, then rows in key order."""
    size = {i: len([w for w in (t or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]) for i, _, t in table}
    sources = sorted({s for _, s, _ in table}, key=lambda s: (s is None, s or ""))
    per = {s: sum(size[i] for i, x, _ in table if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(per.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * per[s] < level * weight[s]}
        for s in full or set(free):
            target[s] = 2 * per[s] if full else level * weight[s]
            left -= target[s] if full else 0
            free.discard(s)
    epochs = {}
    for s in sources:
        whole = int(target[s] // per[s]) if per[s] else 0
        rest, at = target[s] - whole * per[s], 0
        for _, i in sorted((hashlib.md5(f"17:{i}".encode()).hexdigest(), i) for i, x, _ in table if x == s):
            at += size[i]
            epochs[i] = min(2, whole + (at - size[i] / 2 <= rest))
    return epochs


def test_pipeline_by_hand(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert len({i for i, *_ in rows}) == len(rows)
    rows = [r for r in rows if quality_by_hand(r[2], model) >= 0.5]
    kept = near_groups([(i, t) for i, _, t in rows])
    rows = [r for r in rows if r[0] in kept]
    split, windows = decontaminate.normal_words, set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    clean = []
    for r in rows:
        w = split(r[2])
        hit = {p + o for n in {len(x) for x in windows} for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for o in range(n)}
        clean += [] if hit and 20 * len(hit) >= len(w) else [r]
    assert len(clean) < len(docs.collect())
    epochs, text = mixed_by_hand(clean), {i: t for i, _, t in clean}
    tk, at, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for i in sorted(text):
        for _ in range(epochs[i]):
            ids = [*tk.encode(text[i] or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_op2_op10_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) for i in text}
    langs, idf, w, temperature = langid.fit(docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"))
    got = langid.op2_langid(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.held_out == (fold[r.doc_id] % 4 == 2)
        if not langid.has_letter(text[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        at, v = langid.vector(text[r.doc_id], idf)
        z = [(sum(x * w[a, k] for a, x in zip(at, v)) + w[-1, k]) / temperature for k in range(len(langs))]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        assert r.score == pytest.approx(p.max(), abs=1e-4) and (r.lang_pred == langs[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-4)
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1"))
    got = quality.op10_quality(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        p = quality_by_hand(text[r.doc_id], model)
        assert r.held_out == (fold[r.doc_id] % 3 == 1) and r.score == pytest.approx(p, abs=1e-4) and (r.predicted == (p >= 0.5) or abs(p - 0.5) < 1e-4)


def test_scores_of_odd_rows(spark, docs):
    """Repeated rows, clashing names, a very long text and empty tables, for the three classifiers."""
    odd = docs.withColumns({"score": F.lit(7.0), "lang_pred": F.lit("clash"), "y": F.lit(1), "f": F.lit("clash"), "f0": F.lit(3)})
    labels = spark.createDataFrame([(i, i % 2, i % 2, "clash") for i in range(60)] + [(3, 0, 1, "twice"), (4, None, None, None)], "doc_id long, quality int, toxic int, id string")
    n = docs.count()
    machine = quality.fit(odd, labels)
    out = quality.score(odd, machine)
    assert out.columns == [*(c for c in odd.columns if c != "score"), "score"] and all(0 <= r.score <= 1 for r in out.collect())
    kept = quality.score(odd, machine, out="own")
    assert kept.columns == [*odd.columns, "own"] and {r.score for r in kept.collect()} == {7.0}
    for got in (out, langid.predict(odd, langid.fit(odd)).withColumnRenamed("id", "doc_id"), toxicity.score(odd, toxicity.fit(odd, labels)).withColumnRenamed("id", "doc_id")):
        scored = [(r.doc_id, r.score) for r in got.collect()]
        assert len(scored) == n and Counter(i for i, _ in scored)[7] == 2 and len({s for i, s in scored if i == 7}) == 1
    none = toxicity.fit(empty(spark), labels)
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True} and toxicity.score(empty(spark), none).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score >= 0.5").count() == 0
