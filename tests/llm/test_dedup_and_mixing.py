import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrichor.llm import exact_dedup as exact_dedup_module, minhash, mixing
from petrichor.llm.exact_dedup import exact_dedup
from petrichor.llm.line_dedup import duplicate_lines, line_dedup


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(spark, corpus):
    groups = collections.defaultdict(list)
    for i, t in rows_of(corpus):
        groups[t or ""].append(i)
    for size in (32 << 20, 8):  # without a second filter, which may take no more bytes, all rows are grouped
        got = exact_dedup(corpus, filter_bytes=size)
        assert {"row", "_h", "a.b", "keep_id", "group_size", "kept", "text_sha256"} <= set(got.columns)
        for r in got.collect():
            ids = groups[r["text"] or ""]
            keep = max((i for i in ids if i is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(ids), r["doc_id"] == keep, hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert got.count() == corpus.count()
    assert exact_dedup(corpus.limit(0)).count() == 0


def test_filters_of_tasks_merge(spark, monkeypatch):
    """Every repeated hash is found, whichever tasks and flushes saw it, and hardly any single one is let through."""
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows = hashes + hashes[:500] + [hashes[0]] * 2000 + [0, 0, -1, (1 << 63) - 1, -(1 << 63)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(h,) for h in rows], "h bigint").repartition(7)
    for flush in (1 << 22, 50):
        monkeypatch.setattr(exact_dedup_module, "FLUSH", flush)
        slots, bits = exact_dedup_module.repeated_slots(df, "h", rows=len(rows))
        found = {int(p) for r in slots.collect() for p in exact_dedup_module._unpacked(r["places"], r["n"])}
        place = lambda h: (h + (1 << 64)) % (1 << 64) >> (64 - bits)
        times = collections.Counter(map(place, rows))
        assert found == {p for p, n in times.items() if n > 1}
        words, size = exact_dedup_module.bloom_filter(slots)
        passes = lambda h: all(int(words[int(p) >> 6]) >> (int(p) & 63) & 1 for p in (q[0] for q in exact_dedup_module._probes(np.array([place(h)], np.uint64), size)))
        count = collections.Counter(rows)
        assert all(passes(h) for h, n in count.items() if n > 1)
        assert sum(passes(h) for h, n in count.items() if n == 1) < 0.1 * len(count)
    assert exact_dedup_module.bloom_filter(slots, filter_bytes=8) is None


def test_near_duplicates_in_a_group_of_edited_copies(spark):
    """Hundreds of copies edited on their own, 0.5 to 0.9 alike, and copies of these: no link is lost to the buckets."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    texts = [base] + [edited(base, rng.choice([3, 8, 11, 13, 15, 18])) for _ in range(250)]
    texts += [edited(rng.choice(texts), rng.choice([2, 4, 6])) for _ in range(60)] + [[rng.choice(words) for _ in range(90)] for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    want = {i: c for i, _, c in brute_components(rows, 2, 80)}
    assert len(set(want.values())) > 80
    assert sum(r.component_id != want[r.doc_id] for r in got) <= 0.01 * len(rows)


def brute_components(rows, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in sets:
        for y, b in sets:
            if None not in (x, y) and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    return collections.Counter((i, len(s), i if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, corpus, words):
    got = minhash.near_duplicates(corpus, words=words).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows_of(corpus), words, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_link_beyond_the_leader(spark):
    """A chain: each text is close to the next, the ends are far apart; every link counts."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[k * 12 :] + [f"x{k}{i}" for i in range(k * 12)]) for k in range(8)]
    random.Random(1).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash.near_duplicates(df, words=2).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(list(enumerate(texts)), 2, 80)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[k] == 100 for k in range(101, 140))


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def test_line_dedup(spark, prose):
    r = random.Random(3)
    lines = [prose("en", n, n) for n in (3, 7, 8, 9, 12, 20, 21)] + ["", " ", "a  b"]
    docs = []
    for i in range(40):
        own = []
        for _ in range(6):
            w = r.choice(lines).split(" ")
            edit = r.randrange(5)
            at = r.randrange(len(w))
            if edit == 1:
                w[at] = "swapped"
            elif edit == 2:
                w.insert(at, "more")
            elif edit == 3 and len(w) > 1:
                del w[at]
            own.append(" ".join(w))
        docs.append((i - 3, "\n".join(own)))
    docs += [(90, None), (91, ""), (None, "first of all\n" + lines[5])]
    order = sorted(((-(10**9) if i is None else i, k, i, x.strip(" \t\x0b\x0c\r")) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))))
    want, seen = set(), []
    for d, k, i, line in order:
        if not line:
            continue
        w = line.split(" ")
        if any(line == y or max(len(w), len(v)) >= 8 and near(w, v) for y, v in seen):
            want.add((i, k))
        seen.append((line, w))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("near", F.lit(1))
    got = duplicate_lines(df).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == want
    cleaned = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(df).collect()}
    for i, t in docs:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
        n = 0 if t is None else len(t.split("\n"))
        assert cleaned[i] == (kept, n, sum(d == i for d, _ in want))
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_rows_with_one_id(spark, prose):
    """Rows that share an id lose their own repeated lines only; repeated rows and very long lines are no trouble."""
    long_ = prose("en", 4000, 77)
    rows = [(1, "X\nA"), (1, "A\nY unique"), (2, "A"), (3, long_), (4, long_ + " more"), (5, "R\nS"), (5, "R\nS")]
    out = collections.Counter((r["doc_id"], r["text"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert sum(out.values()) == len(rows)
    assert any(i == 1 and t.endswith("Y unique") for i, t in out) and any(i == 1 and t.startswith("X") for i, t in out)
    assert out[2, ""] == 1 and out[3, long_] == 1 and out[4, ""] == 1 and out[5, "R\nS"] == 2


def seats(target, house):
    won = [0] * len(target)
    for _ in range(house):
        i = max(range(len(target)), key=lambda j: (target[j] / (2 * won[j] + 1), -j))
        won[i] += 1
    return won


def test_quotas_are_sainte_lague(spark):
    r = random.Random(2)
    target = [r.choice([0.0, r.uniform(1, 30), r.uniform(100, 4000)]) for _ in range(23)]
    plan = spark.createDataFrame([(i + 1, t) for i, t in enumerate(target)], "rank int, target double")
    got = collections.defaultdict(lambda: [0] * len(target))
    for row in mixing.quotas(plan, block=16, shards=5).collect():
        got[row["shard"]][row["rank"] - 1] = row["blocks"]
    house, total = round(sum(target) / 16), [0] * len(target)
    for h in range(5):
        total = [a + b for a, b in zip(total, got[h])]
        assert total == seats(target, house * (h + 1) // 5)


def test_mixing(spark, corpus):
    got = mixing.mix(corpus, block=8, shards=3).collect()
    again = mixing.mix(corpus.repartition(5), block=8, shards=3).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = collections.Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total = dict.fromkeys(names, 0.0), sum(sizes.values())
    open_, left = set(names), float(total)
    while open_:  # cap and reshare until none is above
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    for r in got:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(target[r["source"]]))
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in names)
    assert mixing.mix(corpus.limit(0)).count() == 0
    assert mixing.mix(corpus.filter("text IS NULL")).select("taken").collect()[0][0] == 0


def test_mixing_by_shard(spark, corpus):
    """Words per shard against streams dealt word by word; the quotas hold, and the shards' number matters."""
    rows = [(i, f"{'w ' * (3 + 7 * i % 23)}", [None, "a", "b", "c"][i % 4]) for i in range(90)] + [(90, "hot " * 700, "a"), (91, None, "c"), (92, " ", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    whole = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=8, shards=5).collect()}
    seen = {}
    for shards in (1, 5):
        got = mixing.mix_by_shard(df, block=8, shards=shards).collect()
        assert {r["doc_id"]: r["taken"] for r in got} == whole
        plan = {p["source"]: p for p in mixing.mixing_plan(df, block=8, shards=shards).collect()}
        for source, p in plan.items():
            docs = sorted((hashlib.md5(f"7|{d}".encode()).hexdigest(), d, len((t or "").split())) for d, t, s in rows if s == source)
            stream = [d for _, d, n in docs for _ in range(n)] * 3
            want, at = collections.Counter(), 0
            for q in p["quotas"] or []:
                run = stream[at : at + 8 * q["blocks"]]
                at += 8 * q["blocks"]
                want.update((d, q["shard"]) for d in run)
            mine = {(r["doc_id"], x["shard"]): x["words"] for r in got if r["source"] == source for x in r["shards"]}
            assert mine == want
        seen[shards] = {r["doc_id"]: r["shards"] for r in got}
    assert seen[1] != seen[5]
    odd = mixing.mix_by_shard(corpus, block=8, shards=3).collect()
    assert len(odd) == corpus.count() and all(r["taken"] <= 3 * r["size"] and r["taken"] == sum(x["words"] for x in r["shards"]) for r in odd)
    assert collections.Counter(r["source"] for r in odd) == collections.Counter(r["source"] for r in corpus.collect())
    assert mixing.mix_by_shard(corpus.limit(0)).count() == 0
