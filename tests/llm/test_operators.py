"""Each operator against a plain version, an exact round trip or held-out accuracy, on the smallest tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, components, embedding_dedup, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, url_filter
from tessera.llm.common import read
from tessera.llm.queries import QUERIES, tokenizer_files

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents").toPandas()


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_rule_statistics(spark, docs):
    r = QUERIES["op6_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        row = r.loc[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert row.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_rules_learn(spark):
    r = QUERIES["op6_quality_rules"](spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    rest = r[~r.base_failed]
    assert (rest[rest.quality == 1].kept.mean() > 0.99) and rest[rest.quality == 0].kept.mean() < 0.1


def test_classifier_learns(spark):
    r = QUERIES["op1_quality_classifier"](spark, SF).join(read(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (r.quality == r.predicted).mean() > 0.9


def test_language_accuracy(spark):
    r = QUERIES["op5_language_id"](spark, SF).join(read(spark, SF, "documents"), "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95


def test_kernel_is_the_presence_kernel():
    import pyarrow as pa

    a, b = "the cat", "the hat"
    x = np.concatenate(list(language_id.presence(pa.array([a, b]))))
    grams = [{(n, t[i : i + n]) for n in language_id.ORDERS for i in range(len(t) - n + 1)} for t in (a, b)]
    assert x[0] @ x[1] == pytest.approx(len(grams[0] & grams[1]) / math.sqrt(len(grams[0]) * len(grams[1])), abs=1e-5)


def test_lm_base_scores(spark, docs):
    r = QUERIES["op3_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in zip(docs.doc_id, docs.text)}
    count = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        row = r.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
    held = r[r.held_out]
    assert held.score.sum() > held.base_score.sum()


def plain_lm(text, count, v, w):
    """log10 probability of a text, token by token in whole numbers; count: token hash to count."""
    import pyarrow as pa

    from tessera.llm import text as tx

    L, bits, most = lm_scoring, (len(w) // 3).bit_length() - 1, (1 << 64) - 1
    (chunk,) = tx.chunks(pa.array([text]))
    h = [int(x) for x in L.Sequence.of(*chunk[2:]).hashes]
    own = {int(x): int(k) for x, k in zip(v.hashes, v.own) if k >= 0}
    total = 0.0
    for i, x in enumerate(h):
        b1, b2, b3 = (h[i - k] if i >= k else int(L.BOS) for k in (1, 2, 3))
        odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
        features = [b1 * odd[0] & most, (b1 * 5 + b2) * odd[1] & most, b2 * odd[2] & most, b3 * odd[3] & most]
        leaf = own.get(x, None)
        shared = leaf is None
        if shared:
            leaf = int(L.shared_leaf(np.array([x], np.uint64))[0])
        paths, steps = (0, leaf // 1024, leaf // 32), (leaf // 1024, leaf // 32 % 32, leaf % 32)
        for level, seen in enumerate(L.LEVELS):
            salt = (paths[level] + (level << 20 | 1)) * 0xFF51AFD7ED558CCD & most
            rows = [((features[f] ^ salt) * 0xC4CEB9FE1A85EC53 & most) >> 64 - bits for f in seen]
            z = v.priors[level][paths[level]].astype(float) + sum(w[(level << bits) + r].astype(float) for r in rows)
            total += z[steps[level]] - np.log(np.exp(z).sum())
        if shared:
            n = count.get(x, 0)
            total += np.log((n - L.DISCOUNT if n else v.unseen[leaf - L.OWN]) / v.mass[leaf - L.OWN])
    return total / np.log(10)


def test_lm_scores_against_a_plain_computation(spark, docs, monkeypatch):
    some = docs[["doc_id", "text"]].head(160)
    frame = spark.createDataFrame(some)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 1200)  # so that rarer words are joined
    counts, v, w = lm_scoring.fit(frame.limit(120), bits=9)
    assert len(v.hashes) <= 1200 and np.abs(w).max() > 0.1
    count = {r.h % (1 << 64): r.n for r in counts.collect()}
    r = lm_scoring.score(frame, counts, v, w, ["doc_id"]).toPandas().set_index("doc_id")
    for i, t in zip(some.doc_id[::8], some.text[::8]):
        assert r.score[i] == pytest.approx(plain_lm(t, count, v, w), rel=1e-4)


def test_lm_probabilities_sum_to_one(spark, docs):
    """All words of a shared leaf and the unseen ones together take at most what the leaf has; leaves add up to 1."""
    L = lm_scoring
    counts, v, _ = L.fit(spark.createDataFrame(docs[["doc_id", "text"]].head(100)), rounds=1, bits=8)
    first, second, third = (np.exp(p.astype(float)) for p in v.priors)
    leaves = (first.reshape(-1, 1, 1) * second.reshape(32, 32, 1) * third.reshape(32, 32, 32)).ravel()
    assert leaves.sum() == pytest.approx(1, abs=1e-3)
    known = counts.toPandas()
    h = known.h.to_numpy().view(np.uint64)
    rest = ~np.isin(h, v.hashes[v.own >= 0])
    taken = np.bincount(L.shared_leaf(h[rest]) - L.OWN, known.n[rest] - L.DISCOUNT, L.SHARED) + v.unseen
    assert (taken <= v.mass + 1e-9).all()


def test_lm_training_does_not_depend_on_the_order_of_sums(spark, docs):
    some = spark.createDataFrame(docs[["doc_id", "text"]].head(60)).repartition(3, "doc_id")
    a, b = (lm_scoring.fit(some, bits=8)[2] for _ in range(2))
    assert np.array_equal(a, b)


def test_lm_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id bigint, text string, known int, base int, uid int")
    (r,) = lm_scoring.score(df, *lm_scoring.fit(df, bits=8), ["doc_id", "known", "base", "uid"]).collect()
    assert (r.known, r.base, r.uid, r.n_tokens) == (5, 6, 7, 3)


def plain_fingerprint(text):
    import xxhash

    w = WORD.findall(text.translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, docs):
    r = QUERIES["op4_simhash"](spark, SF).toPandas().set_index("doc_id")
    some = docs[docs.doc_id % 5 == 0]
    for i, t in zip(some.doc_id, some.text):
        assert r.fingerprint[i] == f"{plain_fingerprint(t):016x}"
    fp = np.array([int(x, 16) for x in r.fingerprint], np.uint64)
    pairs = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2)]
    assert r.component_id.tolist() == [r.index[closure(len(fp), pairs)].values[k] for k in range(len(fp))] or r.groupby(closure(len(fp), pairs)).apply(lambda g: (g.component_id == g.index.min()).all()).all()


@pytest.mark.parametrize("parts", [None, [(list(range(32)), 0), (list(range(32, 64)), 1)]])
def test_links_of_crowded_buckets(spark, monkeypatch, parts):
    """Buckets over the limit take the other, equally exact way; unequal thresholds lose nothing."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    fp = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fp.add(x)
    fp = np.array(sorted(fp), np.uint64)
    if parts:
        monkeypatch.setattr(simhash, "plan", lambda *_: parts)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64), "node": np.arange(len(fp))}))
    want = closure(len(fp), [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2)])
    for bucket in (4, 64):
        found = components.components(simhash.links(nodes, 2, bucket)).toPandas().set_index("node").root
        assert [found.get(i, i) for i in range(len(fp))] == want


def test_thresholds_by_dynamic_programming():
    from itertools import product

    rng = np.random.default_rng(1)
    for parts in (2, 3, 4):
        cost = np.sort(rng.random((parts, 4)), axis=1).tolist()
        best = min(sum(cost[i][t + 1] for i, t in enumerate(c)) for c in product(range(-1, 3), repeat=parts) if sum(t + 1 for t in c) == 3)
        total, chosen = simhash.allot(cost, 2)
        assert total == pytest.approx(best) and sum(t + 1 for t in chosen) == 3


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 3)]
    r = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).toPandas()
    assert set(r[r.node <= 300].root) == {0} and set(r[(r.node >= 1000) & (r.node < 1200)].root) == {1000} and len(r) == 501


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 24)) * rng.choice([0, 0.2, 0.35], (400, 1)), rng.normal(size=(100, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    r = embedding_dedup.near_duplicates(df, strip_rows=100).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert r.n_links.tolist() == link.sum(1).tolist()
    assert r.component_id.tolist() == closure(len(x), zip(*np.nonzero(link)))


def test_mix_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 50), ("d", 0), (None, 500)]
    r = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size bigint, rows bigint")).toPandas()
    weight, cap, total = [1, 2, 3, 1, 2], [3 * n for _, n in sizes], sum(n for _, n in sizes)
    want, held = [0.0] * 5, set()
    while True:
        level = (total - sum(cap[i] for i in held)) / sum(weight[i] for i in range(5) if i not in held)
        want = [cap[i] if i in held else level * weight[i] for i in range(5)]
        over = {i for i in range(5) if want[i] > cap[i]}
        if not over:
            break
        held |= over
    got = {s if isinstance(s, str) else None: t for s, t in zip(r.source, r.target)}
    assert [got[s] for s, _ in sizes] == pytest.approx(want)


def test_apportionment_is_by_highest_quotients(spark):
    shares = [(f"s{i}", float(t)) for i, t in enumerate([5310, 24, 1213, 777, 3, 0, 96, 8])]
    r = mixing.apportion(spark.createDataFrame([(s, 1, 1, t) for s, t in shares], "source string, source_size bigint, rows bigint, target double"), 16).toPandas().set_index("source").seats
    seats, house = Counter(), int(sum(t for _, t in shares) / 16 + 0.5)
    for _ in range(house):
        seats[max(shares, key=lambda s: s[1] / (2 * seats[s[0]] + 1))[0]] += 1
    assert {s: int(r[s]) for s, _ in shares} == {s: seats[s] for s, _ in shares}


def test_mixed_documents_hold_what_was_taken(spark):
    docs = read(spark, SF, "documents")
    mixed = mixing.mix(docs, docs.columns)
    n = mixing.apply_mix(mixed).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    r = mixed.join(n, "doc_id", "left").select("source", "target", "taken", "n").toPandas()
    assert (r.taken == r.n.fillna(0)).all()
    by = r.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() < 0.01 * by.target + 64).all()


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files()["tokenizer_file"])
    r = packing.pack(read(spark, SF, "documents"), ["doc_id"], **tokenizer_files()).toPandas().sort_values(["doc_id", "start"])
    some = docs[docs.doc_id % 10 == 0]
    for i, text in zip(some.doc_id, some.text):
        own = r[r.doc_id == i]
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == [*t.encode(text, add_special_tokens=False).ids, 1] and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    full = r.groupby("sequence_id").length.sum()
    assert (full[full.index < full.index.max()] == 2048).all() and not r.duplicated(["sequence_id", "offset"]).any()


def test_encoders_agree():
    quick = packing.encoder(*tokenizer_files().values())
    exact = packing.encoder(tokenizer_files()["tokenizer_file"], None, None)
    rng = np.random.default_rng(2)
    pool = [*map(chr, range(1, 0x250)), "’", "“", "漢", "\U0001f600", "　", "́", " ", " ", "\n", "'s", "'ll", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(pool, rng.integers(0, 60)))
        assert quick(text).tolist() == exact(text).tolist()


def test_chat_folds_events(spark):
    events = [
        (1, 1, 1, "message", "user", "q"),
        (1, 2, 2, "message", "assistant", "He"),
        (1, 2, 3, "delta", None, "llo"),
        (1, 2, 6, "regenerate", None, None),
        (1, 2, 7, "delta", None, "Bye"),
        (1, 1, 5, "edit", None, "question"),
        (1, 2, 8, "delta", None, "!"),
    ]
    m = chat.fold(spark.createDataFrame(events, "conv_id bigint, message bigint, seq bigint, kind string, role string, text string"))
    rows = [(r.place, r.text) for r in m.orderBy("place").collect()]
    assert rows == [(1, "question"), (2, "Bye!")]


def test_url_propagation(spark):
    pages = [(1, "http://good.org/", '<a href="http://a.net/x">'), (2, "http://a.net/", ""), (3, "http://b.net/p", "<a href='https://evil.com/de/1'>"), (4, "http://evil.com/de/1", ""), (5, "http://c.net/", None), (6, "http://evil.com/en/", "")]
    rules = [("allow", "org/"), ("block", "com/de/")]
    r = url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), rules, ["page_id"]).toPandas().set_index("page_id")
    assert r.verdict.to_dict() == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}
    assert r.trust[2] > 0 and r.distrust[3] > 0


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    p = quality_classifier.Network(x, y, 8, 10, 1).probability(x)
    assert abs(p.mean() - y.mean()) < 0.05 and ((p > 0.5) == y).mean() > 0.75


def test_rule_model_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "word " * 60), (2, "other thing " * 60)], "doc_id bigint, text string")
    model = quality_rules.train(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert quality_rules.apply_rules(docs, model, ["doc_id"]).where(F.col("kept") == F.col("base_failed")).count() == 0


def plain_rank(seeds, edges, damping=0.85):
    """Personalised PageRank by a dense solve; what hosts without links hold returns to the seeds."""
    hosts = sorted({*seeds, *(x for e in edges for x in e)})
    at, n = {h: i for i, h in enumerate(hosts)}, len(hosts)
    p, s = np.zeros((n, n)), np.zeros(n)
    for h, m in seeds.items():
        s[at[h]] = m
    for (a, b), k in edges.items():
        p[at[a], at[b]] += k
    out = p.sum(1)
    p[out > 0] /= out[out > 0, None]
    p[out == 0] = s / s.sum()
    rank = np.linalg.solve(np.eye(n) - damping * p.T, (1 - damping) * s)
    return dict(zip(hosts, rank))


def test_trust_is_personalised_pagerank(spark):
    rng = np.random.default_rng(6)
    edges = Counter((f"h{a}", f"h{b}") for a, b in rng.integers(0, 25, (60, 2)) if a != b)
    seeds = {"h0": 0.5, "h1": 0.25, "h30": 0.25}
    out = Counter()
    for (a, _), k in edges.items():
        out[a] += k
    rows = [("allow", a, b, k / out[a]) for (a, b), k in edges.items()]
    got = url_filter.propagate(spark.createDataFrame([("allow", h, m) for h, m in seeds.items()], "kind string, host string, mass double"), spark.createDataFrame(rows, "kind string, src string, dst string, part double"), tolerance=1e-9).toPandas().set_index("host").trust
    want = plain_rank(seeds, edges)
    for h, m in want.items():
        assert got.get(h, 0.0) == pytest.approx(m, abs=1e-7)
    with pytest.raises(RuntimeError):
        url_filter.propagate(spark.createDataFrame([("allow", "h0", 1.0)], "kind string, host string, mass double"), spark.createDataFrame([("allow", f"h{i}", f"h{i + 1}", 1.0) for i in range(11)], "kind string, src string, dst string, part double"), rounds=3)


def test_many_rules_as_few_and_clashing_columns(spark, monkeypatch):
    pages = [(i, f"http://{h}/{p}", None, 7, 8) for i, (h, p) in enumerate([("A.b.org", "x/1"), ("b.org", "x"), ("ab.org", "x"), ("c.b.org", "y/z"), ("org", ""), ("q.com", "de/"), ("", "x")])] + [(50, None, None, 7, 8)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, h int, kept int")
    rules = [("allow", "org/"), ("block", "b.org/x"), ("allow", "a.b.org/x/"), ("block", "com/de/"), ("block", "c.b.org/y/z")]
    few = url_filter.judge(df, rules, ["page_id", "h", "kept"]).toPandas().sort_values("page_id").reset_index(drop=True)
    assert few.columns[:3].tolist() == ["page_id", "h", "kept"] and (few.h == 7).all() and (few.kept == 8).all()
    assert few.rule.where(few.rule.notna(), None).tolist() == ["a.b.org/x/", "b.org/x", "org/", "c.b.org/y/z", "org/", "com/de/", None, None]
    monkeypatch.setattr(url_filter, "CHAIN", 0)
    many = url_filter.judge(df, rules, ["page_id", "h", "kept"]).toPandas().sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(few, many)


def test_every_language_is_learned(spark):
    """More languages than fill the sample: rare ones are told apart as well as frequent ones."""
    rng = np.random.default_rng(9)
    letters = [list(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)) for _ in range(130)]
    rows = [(i, " ".join("".join(rng.choice(letters[i % 130], 5)) for _ in range(60)), f"l{i % 130:03d}") for i in range(130 * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df, F.col("doc_id") < 130 * 8, documents=400, landmarks=260)
    assert len(model.langs) == 130
    r = language_id.identify(df.where(F.col("doc_id") >= 130 * 8), model, ["doc_id", "lang"]).toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.9


def test_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (4, None)]
    r = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert sorted(zip(r.vec_id, r.n_links, r.component_id)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)]


def test_added_tokens_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokenizer_files()["tokenizer_file"]), packing.encoder(*tokenizer_files().values())
    for text in ("see <|endoftext|> here", "a" + " " * 1_000_000 + "b", "\n" * 1_200_000, "a" + " \t" * 600_000):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_shard_quotas_add_up_by_highest_quotients(spark):
    """Many small shards whose shares round alike: their seats sum to the source's, and are those of a plain highest-quotient count."""
    rng = np.random.default_rng(11)
    rows = [("a", i // 8, i, int(n), 90) for i, n in enumerate(rng.integers(0, 40, 64))] + [(None, 0, i, 7, 10) for i in range(24)]
    r = mixing.divide(spark.createDataFrame(rows, "s string, bunch long, shard long, long long, seats long"), ["s"], "shard", "long", "seats").toPandas()
    for name, house in (("a", 90), (None, 10)):
        own = [(x[2], x[3]) for x in rows if x[0] == name]
        seats = Counter()
        for _ in range(house):
            seats[max(own, key=lambda s: (s[1] / (2 * seats[s[0]] + 1), -s[0]))[0]] += 1
        got = r[r.s.isna()] if name is None else r[r.s == name]
        assert dict(zip(got.shard, got.won)) == {k: seats[k] for k, _ in own}


def test_mix_of_a_source_far_over_its_target(spark):
    """A hot source of short documents, and rows without an id, which are spread over shards by their texts."""
    docs = [(i, " ".join(["w"] * (1 + i % 3)), "hot") for i in range(20_000)] + [(10_000 + i, "x y z " * 40, "b") for i in range(30)] + [(None, f"n{i} " * 20, "c") for i in range(300)]
    r = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), ["source"], fan=16).toPandas()
    by = r.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() < 0.02 * by.target + 32).all() and (r.taken <= 3 * r["size"]).all()
