"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import common, decontaminate, kernels, language, lines, links, quality, shards, simhash, sketches

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def odd(spark, extra=()):
    """Rows with every oddity."""
    rng = random.Random(0)
    long = prose(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, prose(rng, 80)), (None, None), (5, long), (6, prose(rng, 80)), (6, prose(rng, 90)), (7, "twice\ntwice"), (7, "twice\ntwice"), (-4, "ünï 東京 \x00"), (1 << 60, "!!!")]
    return docs(spark, rows, extra)


CLASH = ["rk", "sig", "part", "score", "keep", "shard", "start", "h", "pos", "fp", "__tm_rk", "language", "margin", "line"]


# --- line dedup -----------------------------------------------------------------------------------


def deduped(rows, groups=()):
    """Each line at its first place by (id with null last); equal rows count once and stay alike.

    groups are lists of ids of near copies: their first rows come before the others, and they keep each other's lines.
    """
    at = lambda i: (i is None, i or 0)
    of = {i: n for n, g in enumerate(groups) for i in g}
    late = {i for g in groups for i in sorted(g, key=at)[1:]}
    order = sorted(set((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] in late, at(r[0])))
    seen, gone = {}, {}
    for r in order:
        for k, line in enumerate(r[1].split("\n")):
            if line.strip(" \t\n\v\f\r"):
                first = seen.setdefault(line, (r, k))
                kin = first[0] != r and of.get(r[0], r) == of.get(first[0][0])
                own = any(x == line for x in r[1].split("\n")[:k])
                if first != (r, k) and (own or not kin):
                    gone.setdefault(r, set()).add(k)
    cut = lambda r: (r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r])) if r in gone else r
    return sorted(map(cut, rows), key=repr)


@pytest.mark.parametrize("shard_lines,slice_probes", [(7, 5), (100_000, 1_000_000)])
def test_line_dedup(spark, shard_lines, slice_probes):
    rng = random.Random(4)
    pool = [f"line {i} {prose(rng, 5)}" for i in range(40)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(60)]
    rows += [rows[3], (None, pool[0] + "\nnew"), (90, None), (91, ""), (92, pool[1])]
    df = docs(spark, rows, [*CLASH, "a.b"]).repartition(4).withColumnRenamed("n_chars", "N_CHARS").withColumnRenamed("text", "TEXT")
    got = lines.dedup_lines(df, shard_lines, slice_probes)
    assert got.columns == df.columns
    found = got.collect()
    assert sorted(((r.doc_id, r.TEXT) for r in found), key=repr) == deduped(rows)
    assert all(r.N_CHARS == (None if r.TEXT is None else len(r.TEXT)) for r in found)


def test_line_dedup_of_odd_and_empty_tables(spark):
    df = odd(spark, CLASH)
    assert lines.dedup_lines(df).count() == df.count() and lines.dedup_lines(df.limit(0)).count() == 0
    assert {r.text for r in lines.dedup_lines(df).where("doc_id = 7").collect()} == {"twice"}


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    perfect = lines.PerfectHash.build(keys)
    assert sorted(perfect(keys).tolist()) == list(range(len(keys)))
    index = lines.LineIndex.load(lines.LineIndex.build(keys, np.arange(len(keys)) % 300, np.arange(len(keys))).arrays())
    counts, owners = index.probe(keys)
    assert counts.tolist() == [min(i % 300, 255) for i in range(len(keys))]
    many = counts > 1
    assert owners[many].tolist() == np.flatnonzero(many).tolist()
    assert len(lines.PerfectHash.build(keys[:0])(keys)) == len(keys)


# --- near duplicates ------------------------------------------------------------------------------


def groups_of(rows, distance):
    """Components of all pairs within the distance, by brute force over the same signatures."""
    texts = pa.array([t for _, t in rows], pa.string())
    sig, has = simhash.signatures(texts)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if has[i] and has[j] and np.unpackbits(sig[i] ^ sig[j]).sum() <= distance:
                parent[root(i)] = root(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(root(i), []).append(r[0])
    return sorted(sorted(g, key=lambda x: (x is None, x)) for g in out.values())


@pytest.mark.parametrize("group_rows,hot_rows", [(3, 2), (50_000, 1_000_000)])
def test_near_duplicates_are_those_of_all_pairs(spark, group_rows, hot_rows):
    rng = random.Random(9)
    base = [prose(rng, 150).split() for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8, 40])):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randint(0, 99))
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, "!!!"), (202, None)]
    df = docs(spark, rows, CLASH).repartition(5)
    got = simhash.near_duplicates(df, group_rows=group_rows, hot_rows=hot_rows).collect()
    found = {}
    for r in got:
        found.setdefault((r.group_id, r.group_size), []).append(r.doc_id)
    assert sorted(sorted(g) for g in found.values()) == groups_of(rows, simhash.DISTANCE)
    assert all(n == len(g) and min(g) == i for (i, n), g in found.items())
    assert [r.doc_id for r in got if r.keep] == [r.doc_id for r in got if r.doc_id == r.group_id]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)


def test_the_ring_misses_no_pair():
    rng = np.random.default_rng(3)
    ring = simhash.Ring()
    for d in range(ring.distance + 1):
        a = rng.integers(0, 1 << 63, (30, 2)).astype(np.uint64)
        b = a.copy()
        for i in range(30):
            for bit in rng.choice(128, d, replace=False):
                b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        both = np.concatenate([a, b])
        found = set()
        for i in range(ring.segments):
            for x, y in ring.pairs(both[:, 0].copy(), both[:, 1].copy(), i, 0, 0):
                found |= {(min(p, q), max(p, q)) for p, q in zip(x.tolist(), y.tolist())}
        assert {(i, i + 30) for i in range(30)} <= found


def test_near_duplicates_of_odd_tables(spark):
    df = odd(spark, CLASH)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count() and simhash.near_duplicates(df.limit(0)).count() == 0
    twice = [r for r in got if r.doc_id == 7]
    assert [r.group_size for r in twice] == [2, 2] and sorted(r.keep for r in twice) == [False, True]
    assert simhash.drop_near_duplicates(df).where("doc_id = 7").count() == 1
    assert simhash.drop_near_duplicates(df).where("doc_id is null").count() >= 1
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"{rng.randint(0, 99):02}", f"{rng.randint(0, 99):02}") for _ in range(70)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    got, again = ({bytes(r.node).decode(): bytes(r.root).decode() for r in simhash.components(df, hot).collect()} for hot in (10**6, 3))
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == again == {x: r for x, r in label.items() if x != r}


# --- decontamination ------------------------------------------------------------------------------


def spans(rows, items, least):
    word = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for i, t in rows:
        for j, u in items:
            a, b = word(t), word(u)
            found = []
            for shift in range(-len(b), len(a)):
                run = 0
                for p in range(max(0, shift), min(len(a), len(b) + shift) + 1):
                    if p < min(len(a), len(b) + shift) and a[p] == b[p - shift]:
                        run += 1
                    else:
                        if run >= least:
                            found.append(run)
                        run = 0
            if found:
                out.append((i, j, len(found), max(found)))
    return sorted(out, key=repr)


def test_every_shared_run_is_found(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(12)] + [(50, None), (51, ""), (52, "few words"), (None, prose(rng, 20)), (3, prose(rng, 15))]
    rows = []
    for i in range(60):
        t = prose(rng, 30).split()
        if i % 2:
            w = rng.choice([u for _, u in items if u and len(u) > 40]).split()
            n = rng.randint(5, 15)
            at = rng.randint(0, len(w) - n)
            t[10:10] = [x.upper() + "," for x in w[at : at + n]]
        rows.append((i, " ".join(t)))
    rows += [rows[1], (None, items[0][1]), (70, None), (71, ""), (72, items[2][1] + " " + items[2][1])]
    df = docs(spark, rows, CLASH).repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, fp int")
    least = decontaminate.GRAM + decontaminate.WINDOW - 1
    got = decontaminate.contamination(df, bench).collect()
    want = spans(rows, items, least)
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = decontaminate.decontaminate(df, bench)
    bad = {(i, t) for i, t in rows if spans([(i, t)], items, least)}
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((r for r in rows if r not in bad), key=repr)
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(odd(spark), bench).count() == 12


# --- shards ---------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 50) + "é" * rng.randint(0, 9)) for i in range(300)] + [(None, "abc"), (400, None), (5, "yy"), (5, "yy")]
    got = sorted((tuple(r) for r in shards.shard(docs(spark, rows, CLASH).repartition(6), 7).select("doc_id", "n_bytes", "start", "shard").collect()), key=lambda r: (r[2], r[1]))
    order = sorted(((i, len((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    total, at, want = sum(n for _, n in order), 0, []
    target = math.ceil(total / 7)
    for i, n in order:
        want.append((i, n, at, min(at // target, (total - 1) // target)))
        at += n
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[3] for r in got} == set(range(7))
    assert shards.shard(docs(spark, rows).limit(0)).count() == 0
    assert {r.shard for r in shards.shard(docs(spark, [(1, None), (2, "")])).collect()} == {0}
    assert shards.shard(odd(spark, CLASH)).count() == 12


# --- sketches -------------------------------------------------------------------------------------


def digests(text):
    """The digests of a text's paragraphs, by their definition."""
    out, seen = [], {}
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            seen[line] = seen.get(line, 0) + 1
            out.append(int(hashlib.md5(f"{seen[line]}:{line}".encode()).hexdigest()[:15], 16))
    return out


def changes(rows):
    """version_changes by its definition."""
    distinct = sorted({r for r in rows if digests(r[1])}, key=lambda r: (r[0] is None, r[0] or 0))
    times = {}
    for r in distinct:
        for d in digests(r[1]):
            times[d] = times.get(d, 0) + 1
    last, of = {}, {}
    for r in distinct:
        shared = {}
        for d in digests(r[1]):
            if d in last:
                shared[last[d]] = shared.get(last[d], 0) + sketches.WEIGHT // times[d]
            last[d] = r
        whole = sum(sketches.WEIGHT // times[d] for d in digests(r[1]))
        if shared:
            best = max(shared, key=lambda x: (shared[x], x[0] is None, x[0] or 0))
            if shared[best] * sketches.LEAST_SHARED >= whole:
                of[r] = best
    out = []
    for r in rows:
        now = set(digests(r[1]))
        if r in of:
            before = set(digests(of[r][1]))
            out.append((r[0], of[r][0], len(now), sorted(now - before), sorted(before - now)))
        else:
            out.append((r[0], None, len(now), None, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_version_changes(spark, hot_rows):
    rng = random.Random(10)
    rows, licence = [], "a line that very many rows have"
    for g in range(12):
        body = [licence, *(f"{g} {prose(rng, 6)}" for _ in range(30))]
        for v in range(4):
            rows.append((g * 10 + v, "\n".join(body)))
            for _ in range(rng.choice([0, 1, 5, 60])):
                body[rng.randrange(len(body))] = f"{g} {v} {prose(rng, 6)}"
                if rng.random() < 0.3:
                    body.append(body[rng.randrange(len(body))])
    rows += [(500 + i, f"{licence}\nown {i}\nown too {i}\n{'again' if i % 9 == 0 else i}") for i in range(120)]
    rows += [(900, None), (901, ""), (902, " \n "), (None, rows[0][1]), rows[5], (903, "\n".join(f"{i}" for i in range(3000))), (904, "\n".join(f"{i + 1500}" for i in range(3000)))]
    got = sketches.version_changes(docs(spark, rows, CLASH).repartition(4), cells=9, hot_rows=hot_rows).collect()
    found = sorted(((r.doc_id, r.version_of, r.n_paragraphs, r.added, r.removed) for r in got), key=repr)
    assert found == changes(rows)
    assert sum(r[1] is not None for r in found) > 30 and all(r[1] is None for r in found if r[0] and 500 < r[0] < 600 and (r[0] - 500) % 9)
    assert sketches.version_changes(odd(spark, CLASH)).count() == 12 and sketches.version_changes(odd(spark).limit(0)).count() == 0


def test_digests_and_peeling(spark):
    texts = ["a\n\na\nbb", "é\n é\n\u0085", None, "", "x"]
    df = docs(spark, list(enumerate(texts)))
    assert [sorted(r.digests) for r in sketches.with_digests(df).orderBy("doc_id").collect()] == [sorted(digests(t)) for t in texts]
    assert digests("a\n\na\nbb") == [int(hashlib.md5(x).hexdigest()[:15], 16) for x in (b"1:a", b"2:a", b"1:bb")]
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 20).astype(np.uint64)
    one, two = sketches.Sketch.of(a[:12], 96), sketches.Sketch.of(a[6:], 96)
    assert (one - two).peel() == (sorted(a[:6].tolist()), sorted(a[12:].tolist()))
    assert (sketches.Sketch.of(a, 6) - sketches.Sketch.of(a[:0], 6)).peel() is None
    assert sketches.Sketch.of_rows(np.concatenate([a[:12], a[6:]]), np.repeat([0, 2], [12, 14]), 3, 96) == [x.to_bytes() for x in (one, sketches.Sketch.of(a[:0], 96), two)]
    again = sketches.Sketch.from_bytes(one.to_bytes())
    assert (again - one).peel() == ([], [])


# --- links ----------------------------------------------------------------------------------------


def test_hosts_and_edges(spark):
    pages = [(1, "http://good.org/a", '<a href="http://next.org/x">n</a><a href="/own">o</a>'), (2, "https://Next.org.", '<a href="//far.net/">f</a>'), (3, "http://spam.biz/", "<a href=http://hub.biz>h</a>"), (4, "http://hub.biz/p", '<A HREF="http://spam.biz/q">s</A><a href="http://spam.biz/r">s</a>')]
    pages += [(5, "http://www.good.org", None), (6, "/only/a/path", "<a href='http://x.y'>x</a>"), (7, None, "h"), (8, "", None)]
    df = spark.createDataFrame([(*p, "z", "z") for p in pages], "page_id long, url string, html string, host string, trust string")
    edges = {("good.org", "next.org"): 1, ("good.org", "good.org"): 1, ("next.org", "far.net"): 1, ("spam.biz", "hub.biz"): 1, ("hub.biz", "spam.biz"): 2, ("www.good.org", "good.org"): 1, ("good.org", "www.good.org"): 1}
    assert {(r.src, r.dst): r.weight for r in links.host_edges(df).collect()} == edges
    got = {r.page_id: r for r in links.filter_urls(df, ["good"], ["spam"]).collect()}
    assert {i: r.host for i, r in got.items()} == {1: "good.org", 2: "next.org", 3: "spam.biz", 4: "hub.biz", 5: "www.good.org", 6: None, 7: None, 8: None}
    assert {i for i, r in got.items() if r.keep} == {1, 2, 5} and all(got[i].trust is None for i in (6, 7, 8))
    assert links.filter_urls(df.limit(0), ["a.b"], []).count() == 0 and links.filter_urls(df, [], []).where("keep").count() == 5


def test_linkers_of_blocked_hosts_go_whatever_the_size(spark):
    pages = [(i, f"http://linker{i}.net/", '<a href="http://www.pills.com/">p</a>' + "<a href='/own'>o</a>" * (i % 3)) for i in range(400)]
    pages += [(1000 + i, f"http://www{i % 3}.bad{i}.org/", None) for i in range(1500)]
    pages += [(3000, "http://pills.com/", "x"), (3001, "http://second.net/", '<a href="http://linker7.net/">l</a>'), (3002, "http://clean.net/", '<a href="http://other.net/">o</a>'), (3003, "http://good.org/", '<a href="http://backed.net/">b</a>')]
    pages += [(3004, "http://backed.net/", '<a href="http://pills.com/">p</a><a href="http://x.net">x</a>'), (3005, "http://pillsbury.com/", ""), (3006, None, ""), (3007, "http://rare.net/", '<a href="http://pills.com/">p</a>' + '<a href="http://x.net">x</a>' * 99)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in links.filter_urls(df, ["good"], ["pills", *[f"bad{i}.org" for i in range(1500)]]).collect()}
    assert [i for i, r in got.items() if r.keep and i < 3000] == []
    assert {i for i, r in got.items() if r.keep} == {3002, 3003, 3004, 3005, 3007}
    near = lambda i, x: math.isclose(got[i].distrust, x, abs_tol=1e-6)
    assert near(3000, 1) and near(0, 0.85) and near(2, 0.85) and near(3001, 0.85**2) and near(3004, 0.425) and near(3007, 0.0085) and near(3002, 0)
    assert math.isclose(got[3004].trust, 0.85, abs_tol=1e-6) and got[3006].trust is None


def test_reach_goes_on_until_nothing_changes(spark):
    ring = [(f"h{i}", f"h{i + 1}") for i in range(30)] + [("h1", "h0")]
    edges = spark.createDataFrame([("w", a, b, 1.0) for a, b in ring], "walk string, src string, dst string, weight double")
    got = {r.host: r.score for r in links.reach(edges, spark.createDataFrame([("w", "h30")], "walk string, host string")).collect()}
    want = [0.0] * 30 + [1.0]
    for _ in range(400):
        want = [0.85 * want[1], 0.85 * (want[2] + want[0]) / 2, *[0.85 * want[i + 1] for i in range(2, 30)], 1.0]
    assert len(got) == 31 and all(math.isclose(got[f"h{i}"], w, abs_tol=1e-5) for i, w in enumerate(want)) and got["h0"] > 0


# --- quality --------------------------------------------------------------------------------------


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(40, 200)) + "."
        rows.append((i, text if good else rng.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 90), text.replace(" ", " ### ")])))
        marks.append((i, int(good), 0))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    model = quality.train(*labelled(spark, 500, 1))
    assert 0 < len(model.rules) < 80
    df, marks = labelled(spark, 400, 2)
    got = quality.score(df, model).join(marks, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) >= 0.97 * len(got)
    x = quality.with_statistics(df, lexicon=model.lexicon).select(*quality.NAMES).toPandas().to_numpy()
    assert np.allclose([r.score for r in quality.score(df, model).collect()], model.predict(x, list(quality.NAMES)))
    assert quality.keep_good(df, model).columns == df.columns


def test_quality_of_odd_tables(spark):
    df, marks = labelled(spark, 300, 1)
    model = quality.train(df, marks)
    rows = quality.score(odd(spark, [*CLASH, *quality.NAMES]), model).collect()
    assert len(rows) == 12 and all(not r.keep and r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert quality.keep_good(odd(spark, CLASH), model).columns == odd(spark, CLASH).columns
    assert quality.score(df.limit(0), model).count() == 0
    for bad in (marks.limit(0), marks.where("quality = 1"), marks.withColumn("quality", F.lit(None).cast("int"))):
        found = quality.score(df.unionByName(docs(spark, [(-1, None), (-2, "")])), quality.train(df, bad)).where("keep")
        assert found.count() == df.count() and found.where("doc_id < 0").count() == 0
    assert quality.train(df.limit(0), marks).rules == []


def test_the_sample_is_a_bound_whatever_repeats(spark):
    df, marks = labelled(spark, 60, 1)
    many = df.withColumn("doc_id", F.lit(5).cast("long"))
    seen = []
    real = quality.fit
    quality.fit = lambda x, y, *rest: (seen.append(len(y)), real(x, y, *rest))[1]
    try:
        quality.train(many, marks.where("doc_id = 5").unionByName(marks.where("doc_id = 5")), sample=20)
        quality.train(df, marks.drop("toxic"), sample=50)
    finally:
        quality.fit = real
    assert seen == [20, 50]


def test_toxic_rows_are_rejected_and_clean_ones_stay(spark):
    rng = random.Random(3)
    slurs = ["rotter", "bl\u00f6dmann", "cretin"]

    def rows(n, first):
        out = []
        for i in range(n):
            w = prose(rng, 60).split()
            toxic = i % 5 == 0
            if toxic:
                w[7:7] = [rng.choice(slurs).upper() + "!"]
            elif i % 5 == 1:
                w[3:3] = ["cretinous"]  # no word of the lexicon
            out.append((first + i, " ".join(w), toxic))
        return out

    known, fresh = rows(500, 0), rows(300, 1000)
    marks = spark.createDataFrame([(i, 1, int(x)) for i, _, x in known], "doc_id long, quality int, toxic int")
    model = quality.train(docs(spark, [r[:2] for r in known]), marks)
    assert set(model.lexicon) == set(slurs)
    got = {r.doc_id: r.keep for r in quality.score(docs(spark, [r[:2] for r in fresh]), model).collect()}
    assert all(got[i] == (not x) for i, _, x in fresh)


def test_the_first_rule_is_the_best_split_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=400) > 5).astype(float)
    g, h = y - 0.5, np.full(400, 0.25)
    value = lambda on: g[on].sum() ** 2 / (h[on].sum() + 1)
    every = {(j, c): value(x[:, j] <= c) + value(x[:, j] > c) for j in range(3) for c in range(8) if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= 5}
    j, c = max(every, key=every.get)
    (name, above, bound), *rest = quality.grow(x, y, ["a", "b", "c"], trees=1, depth=1)[0].terms
    assert not rest and (name, above) == ("abc"[j], False) and np.array_equal(x[:, j] <= bound, x[:, j] <= c)


def test_lasso_weights_are_optimal():
    """The conditions that hold at the minimum alone: the loss's slope is the penalty where a weight is, and no more where none is."""
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (1500, 8)).astype(float)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(2 * z[:, 0] - z[:, 1] - 0.5)))).astype(float)
    for penalty in (0.003, 0.02):
        w, b = quality.lasso(z, y, penalty, rounds=5000)
        slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
        on = w != 0
        assert on.any() and np.allclose(slope[on], -penalty * np.sign(w[on]), atol=1e-5) and np.all(np.abs(slope[~on]) <= penalty + 1e-5)
        assert abs(np.mean(1 / (1 + np.exp(-(z @ w + b))) - y)) < 1e-5


def test_lasso_zeroes_what_does_not_matter():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (2000, 6)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 0] - 2)))).astype(float)
    w, _ = quality.lasso(z, y, 0.02)
    assert w[0] > 1 and np.all(np.abs(w[1:]) < 0.1)


# --- language -------------------------------------------------------------------------------------

LANG = {"en": WORDS, "de": "der die und das nicht ein ich ist sie mit auf für sich dem den werden eine wir haben auch nach wird bei noch wie einem über einen so zum kann wenn nur am oder aber vor bis mehr durch man sein wurde sei".split()}


def test_language_on_held_out_rows(spark):
    rng = random.Random(12)
    text = lambda lang, n: " ".join(rng.choices(LANG[lang], k=n))
    schema = "doc_id long, text string, lang string"
    train = spark.createDataFrame([(i, text(x, 60), x) for i, x in enumerate(["en", "de"] * 60)] + [(900, None, "en"), (901, "x", None), (None, "y", "en")], schema)
    known = language.train(train)
    assert set(known) == {"en", "de"}
    truth = [(i, text(x, rng.randint(8, 120)), x) for i, x in enumerate(["en", "de"] * 50)]
    df = spark.createDataFrame(truth, schema).withColumns({c: F.lit("q") for c in ("language", "margin")})
    got = {r.doc_id: r.language for r in language.identify(df, known).collect()}
    assert sum(got[i] == x for i, _, x in truth) >= 95
    rows = language.identify(odd(spark, CLASH), known).collect()
    assert len(rows) == 12 and all(r.language == "und" for r in rows if r.doc_id in (1, 2))
    assert [r.language for r in rows if r.doc_id == 5] == ["en"]
    assert language.identify(df.limit(0), known).count() == 0
    assert language.train(train.limit(0)) == {} and {r.language for r in language.identify(df, {}).collect()} == {"und"}


def test_sizes_and_margins_match_plain_zstandard(spark):
    import zstandard

    rng = random.Random(5)
    schema = "doc_id long, text string, lang string"
    rows = [(i, " ".join(rng.choices(LANG[x], k=rng.choice([3, 80, 4000]))), x) for i, x in enumerate(["en", "de"] * 20)]
    train = spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", i string, l string")
    known = language.train(train, sample=7, size=5000)
    hashed = {r.doc_id: r.h for r in train.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for lang in ("en", "de"):
        chosen = sorted((r for r in rows if r[2] == lang), key=lambda r: (hashed[r[0]], r[0]))[:7]
        pieces = [(i, t.lower()[k : k + language.PIECE]) for i, t, _ in chosen for k in range(0, len(t), language.PIECE)]
        h = [r.h for r in spark.createDataFrame(pieces, "i long, p string").select(F.xxhash64("i", "p").alias("h")).collect()]
        want = b""
        for _, p in sorted(zip(h, (p for _, p in pieces))):
            if len(p.encode()) + 1 <= 5000 - len(want):
                want += p.encode() + b"\n"
        assert known[lang] == want and len(want) > 3000

    def size(text, dictionary):
        raw, total = text.lower().encode(), 0
        for k in range(0, len(raw), language.CHUNK):
            d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[k : k + language.CHUNK]))
        return total

    texts = [(i, " ".join(rng.choices(LANG[x] + LANG["en"][:20], k=n))) for i, (x, n) in enumerate([("en", 5), ("de", 30), ("de", 3000), ("en", 200), ("de", 2)] * 3)] + [(99, "zz"), (100, None)]
    got = {r.doc_id: r for r in language.identify(docs(spark, texts), known).collect()}
    for i, t in texts:
        n = sorted((size(t or "", known[x]), x) for x in known)
        gap = n[1][0] - n[0][0]
        share = gap / max(1, n[1][0])
        assert got[i].language == (n[0][1] if gap >= language.MARGIN_BYTES and share >= language.MARGIN else "und") and math.isclose(got[i].margin, share)
    assert {r.language for r in got.values()} == {"en", "de", "und"}


# --- bytes that are not UTF-8, joins by shuffles --------------------------------------------------


def raw(spark):
    """Texts with bytes that form no UTF-8, as Spark's strings may have them."""
    rows = [(1, bytes([0x61, 0xFF, 0x0A, 0x62])), (2, b"\xc3("), (3, b"plain text"), (4, b"\xed\xa0\x80"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, b binary")
    return df.select("doc_id", F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))


def test_bytes_that_are_not_utf8(spark):
    df = raw(spark)
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    known = {"en": b"the of and", "de": b"der die das"}
    for out in (quality.score(df, quality.Ensemble()), simhash.near_duplicates(df), language.identify(df, known), lines.dedup_lines(df), decontaminate.decontaminate(df, bench), shards.shard(df), sketches.version_changes(df)):
        assert len(out.drop("text").collect()) == 5
    assert set(language.train(df.unionByName(df.withColumn("lang", F.lit("de"))))) == {"en", "de"}
    kept = lines.dedup_lines(df).select("doc_id", F.hex("text").alias("h")).orderBy("doc_id").collect()
    assert [r.h for r in kept] == [r.h for r in df.select("doc_id", F.hex("text").alias("h")).orderBy("doc_id").collect()]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows = [(i, "\n".join(rng.choices([f"line {k} {prose(random.Random(k), 9)}" for k in range(30)], k=6)) + ("\n" + items[i % 5][1] if i % 4 == 0 else "")) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(9)] + [(200, None), rows[3]]
    df, bench = docs(spark, rows, CLASH), spark.createDataFrame(items, "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.net/", '<a href="http://b.org">b</a>'), (2, "http://b.org/", ""), (3, "http://c.net/", "")], "page_id long, url string, html string")

    def everything():
        found = [lines.dedup_lines(df), lines.dedup_lines(df, copies=simhash.copies(df)), simhash.drop_near_duplicates(df), decontaminate.contamination(df, bench), decontaminate.decontaminate(df, bench), sketches.version_changes(df), links.filter_urls(pages, ["c"], ["b"])]
        return [sorted(map(repr, x.collect())) for x in found]

    want = everything()
    monkeypatch.setattr(common, "small", lambda *_: False)
    assert everything() == want


def test_no_groups_rows_meet_in_one_task(spark):
    """Joins to hot groups are by broadcast of these, and aggregates are prepared by each task: no window over a group."""
    df = docs(spark, [(i, "one and the same text") for i in range(50)] + [(100 + i, f"another text {i}") for i in range(20)])
    for hot in (5, 1_000_000):
        rows = simhash.near_duplicates(df, hot_rows=hot)
        assert "Window" not in rows._jdf.queryExecution().toString()
        assert rows.where("group_size = 50").count() == 50 and rows.where("keep").count() == len({r.group_id for r in rows.collect()})


# --- kernels --------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    texts = ["It's A_b-c 12½ é\nß", "", None, "東京 Тест"]
    h, row = [], []
    for part in kernels.slices(pa.array(texts, pa.string()), 4):
        a, b = kernels.words(part)
        h += a.tolist()
        row += (b + part.first).tolist()
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W_]+", (t or "").lower())]
    assert row == [i for i, _ in want]
    assert len({(x, w) for x, (_, w) in zip(h, want)}) == len(set(h)) == len({w for _, w in want})
