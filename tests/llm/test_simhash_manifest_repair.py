"""SimHash groups, Merkle manifests and repaired conversations against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from petrichor.llm import conversations, merkle, simhash


# ---- SimHash ---------------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if x]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, radius=2):
    """{fingerprint: smallest id reachable} of {fingerprint: smallest id}."""
    own = {p: p for p in prints}

    def find(p):
        while own[p] != p:
            p = own[p]
        return p

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                own[find(a)] = find(b)
    least = {}
    for p in keys:
        least[find(p)] = min(least.get(find(p), 1 << 62), prints[p])
    return {p: least[find(p)] for p in keys}


def test_simhash_of_documents(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(corpus).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t in rows)
    least = {}
    for i, t in rows:
        if i is not None:
            p = plain_fingerprint(t)
            least[p] = min(least.get(p, 1 << 62), i)
    want = plain_groups(least)
    assert all(r.component_id == (want[int(r.fingerprint, 16)] if r.doc_id is not None else None) for r in got)
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {60: 60, 61: 60, 62: 60}  # NULL, empty and blank texts are one group
    assert simhash.near_duplicates(corpus.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("pairs", [1, 32])
def test_simhash_links_in_crowded_entries(spark, monkeypatch, pairs):
    """A dense ball of fingerprints, chains, and strangers; with few pairs allowed all entries take the other way."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(4)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(250):  # up to five bits around one centre, mostly in two bytes
        p = centre
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.choice([*range(8, 24), *range(64)])
        prints.add(p)
    chain = rng.getrandbits(64)
    for _ in range(40):
        prints.add(chain)
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    prints |= {rng.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1, (1 << 64) - 2}
    ids = {p: i for i, p in enumerate(rng.sample(sorted(prints), len(prints)))}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p), i) for p, i in ids.items()], "print bigint, rep bigint")
    found = simhash.links(df).collect()
    by_id = {i: p for p, i in ids.items()}
    assert all((by_id[r.a] ^ by_id[r.b]).bit_count() == r.bits <= 2 for r in found)
    from petrichor.llm.minhash import components

    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    assert {i: got.get(i, i) for i in by_id} == {ids[p]: c for p, c in plain_groups(ids).items()}
    with pytest.raises(ValueError, match="radius"):
        simhash.links(df, radius=4)


# ---- Merkle manifest -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("pairs", [1, 32])
def test_simhash_entries_are_not_broadcast(spark, monkeypatch, pairs):
    """The fingerprints are small enough for a broadcast, their 28 entries each are not."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(11)
    bases = [rng.getrandbits(63) for _ in range(3000)]
    near = [0, 1, 3, 1 << 40]
    df = spark.createDataFrame([(p ^ x, 4 * i + j) for i, p in enumerate(bases) for j, x in enumerate(near)], "print bigint, rep bigint")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # a broadcast of more fails
    try:
        found = simhash.links(df).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert all(r.a // 4 == r.b // 4 and r.bits == (near[r.a % 4] ^ near[r.b % 4]).bit_count() <= 2 for r in found)
    got = {(r.a, r.b) for r in found}
    assert len(got) == len(found) and all({(4 * i + 1, 4 * i), (4 * i + 3, 4 * i)} <= got and got & {(4 * i + 2, 4 * i), (4 * i + 2, 4 * i + 1)} for i in range(len(bases)))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row, low=False):
    parts = []
    for c in merkle.LEAF:
        v = row[c]
        if v is None:
            parts.append("-")
            continue
        v = str(v)
        if c == "text" and low:
            v = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in v)
        parts.append(f"{len(v.encode())}:{v}")
    return sha("".join(parts))


def plain_tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def plain_path(levels, i, fan):
    out = []
    for level in levels[:-1]:
        b = i // fan * fan
        out.append(("".join(level[b:i]), "".join(level[i + 1 : b + fan])))
        i //= fan
    return out


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


@pytest.mark.parametrize("depth,fan", [(4, 8), (1, 8), (2, 3)])
def test_merkle_manifest(spark, corpus, monkeypatch, depth, fan):
    """Many rounds and one, small and large groups, repeated rows, NULL ids and groups."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    docs = corpus.select(*merkle.LEAF, "row", "kept")
    more = spark.range(1000, 1100).select(F.col("id").alias("doc_id"), F.lit("S").alias("source"), F.lit("hot").alias("lang"), F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"), F.lit(0).alias("row"), F.lit("x").alias("kept"))
    docs = docs.unionByName(more)
    mark = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    got = merkle.manifest(docs, tampered=mark, fan=fan).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["lang"], []).append(r.asDict())
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]], fan)
    upper = plain_tree([trees[g][-1][0] for g in names], fan)
    root, want = upper[-1][0], []
    for n, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = plain_path(trees[g], i, fan) + plain_path(upper, n, fan)
            now = plain_leaf(r, tampered(r["doc_id"]))
            for left, right in path:
                now = sha(left + now + right)
            want.append((r["doc_id"], g, i, trees[g][0][i], trees[g][-1][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    own = [(r.doc_id, r.group, r.rank, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got]
    assert sorted(own, key=str) == sorted(want, key=str)
    assert {r.verified for r in got} == {True, False}


def test_merkle_manifest_of_little(spark, corpus):
    docs = corpus.select(*merkle.LEAF)
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.filter("doc_id = 5")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof == [] and one.proof_sha256 == sha("")


# ---- conversations ---------------------------------------------------------------------------------------------
def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if c == 1:
            text = ""
        if c == 2:
            text = re.sub("[.!?]", "", text)
        if c == 4:
            role = "user"
        out += [] if c == 0 else [(turn, role, text)] * (2 if c == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def plain_repair(rows):
    """All edits by dynamic programming over whole edit strings; up to three insertions before each message."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    follows, names = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def inserted(best):
        for q, (cost, audit, lines) in best.items():
            for _ in range(4):
                yield q, cost, audit, lines
                q = follows[q]
                cost, audit, lines = cost + 2, audit + "I", (*lines, names[q] + ":")

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new, cut = {}, fault == "truncated"
        for q, cost, audit, lines in inserted(best):
            ways = [(q, cost + 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                to = follows[q]
                ways.append((to, cost + 2 + cut, "R", (f"{names[to]}:{text}",)))
                if role[:1] == to:
                    ways.append((to, cost + cut, "K", (f"{role}:{text}",)))
                if role[:1] == "s" and q == "":
                    ways.append(("s", cost + cut, "K", (f"{role}:{text}",)))
            for to, c, edit, more in ways:
                way = (c, audit + edit, lines + more)
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    cost, audit, lines = min((c, a, x) for q, c, a, x in inserted(best) if q in ("", "a"))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))


@pytest.mark.parametrize("run", [256, 3])
def test_conversation_repair(spark, monkeypatch, run):
    """Whole conversations, and the same cut into runs of three messages, then runs of three runs, and so on."""
    monkeypatch.setattr(conversations, "RUN", run)
    rng = random.Random(run)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "More.  ", "same. ", "été…", "x" * 5000 + ".", None, "a\x1c", "e!\x1f"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle", "Sys"]
    rows = [(c, rng.choice([None, *range(14)]) if c % 3 else t, rng.choice(roles), rng.choice(texts)) for c in range(24) for t in range(rng.randint(1, 14))]
    rows += [(None, t, "user" if t % 2 else "assistant", "Ok.") for t in range(5)] + [(99, 1, "user", "Twice.")] * 4
    rows += [(7777, t, rng.choice(roles[:5]), f"{rng.choice(['a', 'b'])}{t}{rng.choice(['.', ''])}") for t in range(150)]
    dropped = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"key": F.lit(1), "task": F.lit("x"), "cost": F.lit(2)})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == plain_repair(plain_damage(own)), conv
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0


def test_crossings_are_those_of_the_whole_table():
    """The states found by divide and conquer give the least edits of all paths."""
    rng = random.Random(1)
    kinds = [("u", False, False), ("a", False, True), ("s", False, False), ("", False, False), ("a", True, False), ("u", False, True)]
    for _ in range(300):
        parts = [rng.choice(kinds) for _ in range(rng.randint(1, 7))]
        tables = [conversations.message(*k) for k in parts]
        end, cost, more = conversations.closing(conversations.composed(tables))
        states = conversations.crossings(tables, 0, end)
        edits = [conversations.steps(*k)[p, q] for k, p, q in zip(parts, states, states[1:])]
        best = {0: (0, "")}
        for k in parts:
            now = {}
            for p, (c, e) in best.items():
                for (a, q), (paid, edit) in conversations.steps(*k).items():
                    if a == p:
                        now[q] = min(now.get(q, (1 << 30, "")), (c + paid, e + edit))
            best = now
        tail = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
        assert (cost, "".join(e for _, e in edits) + more) == min((c + tail[q][0], e + tail[q][1]) for q, (c, e) in best.items())
