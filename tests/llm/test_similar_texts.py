"""The wide SimHash search and the check over whole sets against all pairs."""

import re
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import cells, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def closed(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"Word{i}" for i in range(900)]
    passage = list(rng.choice(vocabulary, 60))
    out = [(900, None), (901, " \n"), (902, ""), (903, "three short words"), (904, "Three SHORT words"), (905, "three short")]
    for centre in range(6):
        words = list(rng.choice(vocabulary, 120)) + (passage if centre % 2 else [])
        for _ in range(12):
            own = list(words)
            for at in rng.choice(len(own), rng.integers(0, 5), replace=False):
                own[at] = "edit" + str(rng.integers(1 << 30))
            out.append((len(out), " ".join(own)))
    for _ in range(20):
        out.append((len(out), " ".join([*passage, *rng.choice(vocabulary, rng.integers(2, 40))])))
    return out + [(7000, " ".join(passage[::-1])), (7000, " ".join(passage[::-1]) + " one more")]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_similar_texts_against_all_pairs(spark, rows, monkeypatch, chunk):
    """No pair within the radius is lost, none below the similarity is linked; cells over a task's size are no exception."""
    monkeypatch.setattr(cells, "CHUNK_ROWS", chunk)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    r = simhash.similar_texts(df, radius=12).toPandas()
    assert len(r) == len(rows)
    got, sets = dict(zip(r.doc_id, r.component_id)), [shingles(t) for _, t in rows]
    fp = dict(simhash.profiles(df.selectExpr("doc_id", "text").where("doc_id <> 7000"), 5, 2).select("doc_id", "fp").collect())
    alike = lambda i, j: rows[i][0] == rows[j][0] or sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    close = lambda i, j: rows[i][0] == rows[j][0] or 7000 not in (rows[i][0], rows[j][0]) and ((fp[rows[i][0]] ^ fp[rows[j][0]]) & (1 << 64) - 1).bit_count() <= 12
    most, least = closed(len(rows), alike), closed(len(rows), lambda i, j: alike(i, j) and close(i, j))
    name = lambda root: {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))}
    most, least = name(most), name(least)
    assert len(set(most.values())) < 0.6 * len(most)
    for i in got:
        assert most[got[i]] == most[i] and got[least[i]] == got[i]
    assert sum(got[i] == most[i] for i in got) >= 0.9 * len(got)


@pytest.mark.parametrize("dense,piece,bits,most", [(64, 1 << 20, 16, 1), (4, 50, 16, 2), (4, 50, 24, 1), (2, 7, 9, 1)])
def test_a_block_joins_what_lies_within_the_radius(monkeypatch, dense, piece, bits, most):
    monkeypatch.setattr(cells, "DENSE", dense)
    monkeypatch.setattr(cells, "PIECE", piece)
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fp = []
    for c in centre:
        for _ in range(40):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 9), replace=False):
                x ^= 1 << int(b)
            fp.append(x)
    fp, n = np.array(fp, np.uint64), rng.integers(80, 110, len(fp))
    own = rng.random(len(fp)) < 0.7
    part = sorted(rng.choice(64, bits, replace=False).tolist())
    root = cells.Block(fp, n, own, part, 8, Fraction(4, 5)).run(cells.masks(bits, most))
    code = cells.extract(fp, part)

    def linked(i, j):
        return (own[i] or own[j]) and (int(code[i]) ^ int(code[j])).bit_count() <= most and (int(fp[i]) ^ int(fp[j])).bit_count() <= 8 and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])

    assert root.tolist() == closed(len(fp), linked)


def test_plan_leaves_no_pair_out():
    """Thresholds add up so that fingerprints within the radius agree in some partition."""
    rng = np.random.default_rng(2)
    for radius in (2, 5, 10):
        cost = np.sort(rng.random((4, radius + 2)) * 100, axis=1).tolist()
        _, chosen = simhash.allot(cost, radius)
        assert sum(t + 1 for t in chosen) == radius + 1


def test_pipeline_stage_drops_copies_beyond_two_bits(spark):
    from corpus_pipeline import near_duplicate_stage

    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    for i in (20, 90, 160):
        near[i] = "edit"
    for i in range(10, 200, 15):
        far[i] = "edit"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, far))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_duplicate_stage(spark, docs, "").collect()) == [0, 2]
