"""Line dedup and SimHash classes against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pairloom.llm import line_dedup, near_copies, simhash
from pairloom.llm.components import connected_components
from pairloom.llm.cuckoo import build

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y") for i, t in rows], SCHEMA)


def test_filter_keeps_what_was_not_deleted():
    keys = np.random.default_rng(5).integers(0, 2**63, 30_000).astype(np.uint64)
    made = build(keys)
    assert made.contains(keys).all() and len(made) == len(keys)
    made.delete(keys[:20_000])
    assert made.contains(keys[20_000:]).all()
    assert made.contains(keys[:20_000]).mean() < 0.05
    assert made.insert(keys[:20_000]) and made.contains(keys).all()
    assert len(build(keys[:0])) == 0


def plain_line_dedup(rows, min_docs=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= 20 else None

    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if key(line):
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not key(x) or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    draw = random.Random(3)
    shared = [f"Shared line number {n} which is long enough É" for n in range(12)]
    rows = []
    for i in range(60):
        lines = [draw.choice(shared) for _ in range(draw.randrange(4))]
        lines += [f"  own {i} {n} and some more text\t" for n in range(draw.randrange(3))] + ["short", "", "\x85" + "x" * 18]
        draw.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if draw.random() < 0.3 and "É" not in x else x for x in lines)))
    hot = "the very common line of this corpus"
    rows += [(100 + i, f"{hot}\n{hot}\nown text of document number {i}") for i in range(40)]
    return [*rows, (300, None), (301, ""), (302, "\n"), (None, hot), (303, hot + "\n" + "w " * 50_000), *rows[:2]]


def as_set(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_line_dedup_matches_brute_force(spark):
    rows = line_rows()
    docs = docs_of(spark, rows)
    got = as_set(line_dedup.deduplicate(docs, line_dedup.create(docs)), "doc_id", "kept", "n_lines", "n_dropped")
    assert got == sorted(plain_line_dedup(rows), key=str)


def test_line_dedup_is_incremental_and_reversible(spark):
    rows = [r for r in line_rows() if r[0] is not None][:100]
    first, second = docs_of(spark, rows[:60]), docs_of(spark, rows[60:])
    both = docs_of(spark, rows)
    start = line_dedup.create(first)
    grown = line_dedup.insert(start, second)
    assert as_set(grown.table("counts"), "key", "n_docs", "max_doc") == as_set(line_dedup.create(both).table("counts"), "key", "n_docs", "max_doc")
    assert as_set(line_dedup.deduplicate(both, grown), "doc_id", "kept") == sorted([r[:2] for r in plain_line_dedup(rows)], key=str)
    back = line_dedup.delete(grown, second.select("doc_id"))
    assert as_set(back.table("counts"), "key", "n_docs", "max_doc") == as_set(start.table("counts"), "key", "n_docs", "max_doc")
    assert as_set(line_dedup.deduplicate(first, back), "doc_id", "kept") == as_set(line_dedup.deduplicate(first, start), "doc_id", "kept")
    keys = back.table("filters").agg({"n_keys": "sum"}).first()[0]
    assert keys == back.table("counts").where("n_docs >= 3").count()


def test_line_dedup_of_nothing(spark):
    none = docs_of(spark, [])
    assert line_dedup.deduplicate(none, line_dedup.create(none)).count() == 0


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if bin(a ^ b).count("1") <= 2:
            parent[root(a)] = root(b)
    return {p: root(p) for p in parent}


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_matches_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", bucket)
    draw = random.Random(11)
    base = [f"w{draw.randrange(400)}" for _ in range(300)]
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one"), (8, "ONE"), (None, "one"), (7, "Two words"), (6, " x É É é")]
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randrange(3)):
            copy[draw.randrange(300)] = "changed"
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(f"v{draw.randrange(900)}" for _ in range(40))) for i in range(30)]
    rows += rows[8:12]
    got = simhash.near_duplicate_classes(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, text in rows:
        prints.setdefault(plain_fingerprint(text), set()).add(i)
    roots = plain_classes(list(prints))
    least = {}
    for p, ids in prints.items():
        least[roots[p]] = min([x for x in (*ids, least.get(roots[p])) if x is not None], default=None)
    expected = sorted(((i, plain_fingerprint(t), least[roots[plain_fingerprint(t)]]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == expected


def test_keep_one_per_class(spark):
    rows = [(4, "a b c d e"), (2, "A b c d e"), (2, "a b c d e"), (9, "other text here"), (None, "a b c d e")]
    kept = simhash.keep_one_per_class(docs_of(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]
    assert kept.columns == docs_of(spark, rows).columns


def five_word_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near_copies(rows):
    """The smallest id reachable over pairs of texts with a five-word similarity of 0.8."""
    sets = {i: five_word_sets(t) for i, t in rows}
    parent, holders = {i: i for i in sets}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    empty = [i for i in sets if not sets[i]]
    met = {(empty[0], i) for i in empty[1:]}
    for i in sorted(sets):
        for shingle in sets[i]:
            met |= {(j, i) for j in holders.setdefault(shingle, [])}
            holders[shingle].append(i)
    for a, b in met:
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("bucket", [64, 3])
def test_near_copies_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "PAIRED_BUCKET", bucket)
    draw = random.Random(12)
    base = [f"w{draw.randrange(400)}" for _ in range(200)]
    rows = [(5, None), (3, ""), (4, "one"), (8, "ONE"), (7, "Two words"), (6, "a b c d e f g h i j"), (2, "a b c d e f g h i")]
    for i in range(70):
        copy = list(base)
        for _ in range(draw.randrange(10)):
            copy[draw.randrange(200)] = f"new{draw.randrange(1000)}"
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(f"v{draw.randrange(900)}" for _ in range(40)) + " this one passage is shared by all of these") for i in range(30)]
    rows += rows[9:12]
    roots = plain_near_copies(rows)
    texts = dict(rows)
    far = [1 for i, root in roots.items() if i != root and bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[root])).count("1") > 2]
    assert len(far) > 5  # what two bits of the three-word fingerprint do not link
    got = near_copies.near_copy_classes(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, roots[i]) for i, _ in rows)


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark):
    words = [f"w{n * 37 % 211}" for n in range(210)]
    near = [w if n not in (40, 90, 150) else "other" for n, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "something else altogether in this text")]
    assert bin(plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).count("1") > 2
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_fingerprints_link_first(spark):
    draw = random.Random(5)
    rows = []
    for i in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        rows += [(100 * i + 1, " ".join(words)), (100 * i + 2, " ".join([*words[:-1], "other"])), (100 * i + 3, " ".join([*words[:-9], *["else"] * 9]))]
    sets = {int(near_copies._names([near_copies.shingle_set(t.encode())])[0]): near_copies.shingle_set(t.encode()) for _, t in rows}
    prints = {name: simhash.majority(s) for name, s in sets.items()}
    near = {(a, b) for a, b in combinations(sorted(sets), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2 and len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert len(near) > 5 and len(set(prints.values())) > 12
    _, classes = near_copies._classes(docs_of(spark, rows))
    linked = near_copies.fingerprint_links(docs_of(spark, rows), classes)
    got = {(r.a, r.b) for r in linked.collect()}
    # sets of one fingerprint go by their least, so all are connected but not all are pairs
    assert got <= near
    assert plain_classes_of(near) == plain_classes_of(got)
    roots = {r["name"]: r["root"] for r in near_copies._with_roots(classes, linked).collect()}
    joined = plain_classes_of(got)
    assert set(roots) == set(sets) and all(joined.get(n, n) == joined.get(r, r) for n, r in roots.items())
    assert sum(n != r for n, r in roots.items()) > 5


def plain_classes_of(pairs):
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return parent


def test_components_of_paths_stars_and_nothing(spark):
    path = [(n, n + 1) for n in range(-40, 40)]
    star = [(1000, 1000 + n) for n in range(1, 50)]
    edges = spark.createDataFrame([*path, *star, (7777, 7777)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{n: -40 for n in range(-40, 41)}, **{1000 + n: 1000 for n in range(50)}}
    assert connected_components(edges.where("u > 9000")).count() == 0


def test_hash_of_kept_text(spark):
    rows = [(1, "x\ny")]
    docs = docs_of(spark, rows)
    kept = line_dedup.deduplicate(docs, line_dedup.create(docs)).first()
    assert hashlib.sha256(kept.kept.encode()).hexdigest() == hashlib.sha256(b"x\ny").hexdigest()
