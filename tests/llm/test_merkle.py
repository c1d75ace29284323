import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from guestlens.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, place int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes):
    """The root, and for each leaf what stands left and right of it at each level."""
    paths, below, nodes = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(nodes) > 1:
        upper, leaves = [], []
        for start in range(0, len(nodes), 8):
            run = nodes[start : start + 8]
            for j in range(len(run)):
                for leaf in below[start + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            upper.append(digest(*run))
            leaves.append(sum(below[start : start + 8], []))
        nodes, below = upper, leaves
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row, digest(*map(field, row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(tree([leaf for _, leaf in groups[g]]))
    root, upper = tree([t[0] for t in trees])
    out = Counter()
    for g, (subroot, paths), above in zip(order, trees, upper):
        for (row, leaf), path in zip(groups[g], paths):
            altered = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                altered[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            folded = digest(*map(field, altered))
            for left, right in path + above:
                folded = digest(left, folded, right)
            out[row[0], leaf, subroot, root, digest(*(a + b for a, b in path + above)), folded, folded == root] += 1
    return out


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return M.merkle_manifest(docs, tampered=tampered, changes={"text": lambda c: F.translate(c, letters, letters.lower())})


def invented(rng, n, langs):
    texts = [None, "", "Abc É", "x", "ZZ", "Long " * 20_000]
    rows = [(rng.choice([None, i, i, i, i]), rng.choice([None, "s", "ü"]), rng.choice(langs), rng.choice([None, 3]), rng.choice(texts)) for i in range(n)]
    return rows + rows[:3] + rows[:1] * min(n, 40)


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("n, langs", [(1, ["a"]), (5, [None, "", "en", "é"]), (600, [None, *["en"] * 9, "fr", *(f"l{i}" for i in range(20))])])
def test_rows_equal_brute_force(spark, monkeypatch, levels, n, langs):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 8**levels)
    rows = invented(random.Random(n), n, langs)
    assert Counter(map(tuple, manifest(spark, rows).collect())) == brute(rows)


def test_single_row_and_empty_table(spark):
    (row,) = manifest(spark, [(1, None, None, None, None)]).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == digest()
    assert manifest(spark, []).collect() == []


def test_every_lower_cased_letter_is_noticed(spark):
    got = manifest(spark, [(i, "s", "en", 1, f"Text {i}") for i in range(50)]).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 0}
