"""The corpus operators against brute force, exact round trips and held-out labels."""

import functools
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loam.llm import common, exact_dedup, katz, media, mixing, near, pieces, sharding, simhash, toxicity, url_filter, warc

DOCS = "doc_id long, text string, source string, digest string, bucket int, h long, size long, n long, score double, __copy int"


def frame(spark, rows):
    """documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, s, "d", 1, 2, 3, 4, 5.0, 6) for i, t, s in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "漢字", "😀", "A\tB"]
    out = [(None, "null id", "a"), (1, None, "a"), (2, "", None), (3, " \n\t", "b"), (4, "x", "b"), (5, "word " * 30000, "a"), (6, "x" * 50000, "c")]
    for k in range(7, 90):
        out.append((k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))), "abc"[k % 3] if k % 4 else "a"))
    out += [(k, out[k - 70][1], "a") for k in range(90, 130)]
    out += [(k, f"{out[20][1]} {'tail ' * (k % 3)}", "b") for k in range(130, 140)]
    out += [out[30], (141, "a  b", "c"), (142, "a b ", "c"), (143, "ab", "c"), (144, "  text ▁ with▁▁mark\r\n", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_shards_fit_and_match_a_split_by_hand(spark, rows, docs):
    limit = 3000
    got = sharding.shard(docs, "doc_id", "text", limit).collect()
    assert len(got) == len(rows)
    bits = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) >> 2
    coded = []
    for i, t, _ in rows:
        key = "" if i is None else str(i)
        coded.append((f"{bits(key) << 30 | bits(key + ':' + (t or '')):060b}", len((t or "").encode())))
    wanted, todo = Counter(), [("", coded)]
    while todo:
        prefix, held = todo.pop()
        if sum(n for _, n in held) <= limit or len(held) <= 1 or len(prefix) == 60:
            if held:
                wanted[prefix, sum(n for _, n in held), len(held)] += len(held)
        else:
            todo += [(prefix + b, [x for x in held if x[0].startswith(prefix + b)]) for b in "01"]
    assert Counter((r.shard, r.shard_bytes, r.shard_rows) for r in got) == wanted
    assert all(r.fits or r.shard_rows == 1 for r in got)


def test_one_key_is_split_by_its_rows(spark):
    same = spark.createDataFrame([("k", f"text {k}") for k in range(64)], "key string, text string")
    got = sharding.shard(same, "key", "text", 40).collect()
    assert max(r.shard_bytes for r in got) <= 40 and len({r.shard for r in got}) > 8


def test_shards_are_written_once_by_row(spark, docs, rows, tmp_path):
    same = frame(spark, [(None, f"null {k}", "a") for k in range(20)] + [(1, f"text {k}", "a") for k in range(40)] + [(2, "twice", "a")] * 2)
    assigned = sharding.shard(same, "doc_id", "text", 60)
    path = str(tmp_path / "shards")
    sharding.write(same, assigned, "doc_id", path)
    got = spark.read.schema(same.schema.add("shard", "string")).parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in same.collect())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text)
    assert sizes == {r.shard: r.shard_bytes for r in assigned.collect()}


def test_directory_covers_every_slot_once(spark, docs):
    slots = sharding.directory(sharding.shard(docs, "doc_id", "text", 20000)).collect()
    assert sum(r.slots for r in slots) <= 1 << slots[0].global_depth
    ends = sorted((r.first_slot, r.first_slot + r.slots) for r in slots)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def best_of(group):
    return min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]


def test_exact_groups(rows, docs):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(plain(r[1]).encode()).hexdigest()].append(r)
    wanted = Counter((i, best_of(groups[d]), len(groups[d]), i == best_of(groups[d]), d) for i, t, _ in rows for d in [hashlib.sha256(plain(t).encode()).hexdigest()])
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs, digests_per_bucket=8).collect()) == wanted


def test_cuckoo_filter_grows_and_forgets():
    bucket = exact_dedup.Bucket(2)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(500)]
    for k, key in enumerate(keys):
        bucket.insert(key, 1, k, k)
        bucket.insert(key, 2, k + 1, k)
    assert bucket.filter.width > 2 and all(bucket.find(k) for k in keys)
    for key in keys[::2]:
        bucket.delete(key)
    assert all((bucket.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert bucket.find(keys[1])[1:] == [3, 2, 1]


def test_equal_fingerprints_are_verified():
    bucket = exact_dedup.Bucket(4)
    # Digests of one mark and one place, which the filter cannot tell apart.
    keys = [b"\x01\x02" + b"\0" * 8 + bytes([k]) * 22 for k in range(6)]
    for k, key in enumerate(keys):
        assert bucket.find(key) is None
        bucket.insert(key, 1, k, k)
    assert all(bucket.find(key)[1:] == [1, k, k] for k, key in enumerate(keys))
    bucket.delete(keys[2])
    assert bucket.find(keys[2]) is None and all(bucket.find(k) for k in keys[3:])


def test_index_takes_insertions_and_deletions(spark, docs):
    hashed = exact_dedup.digests(docs)
    index = exact_dedup.update(exact_dedup.empty_index(spark), exact_dedup.entries(hashed, 4))
    stored = common.stored(index, "index")
    gone = exact_dedup.entries(exact_dedup.digests(docs.where("doc_id = 4")), 4).select("bucket", "digest")
    after = exact_dedup.update(stored, exact_dedup.entries(exact_dedup.digests(docs.where("doc_id = 143")), 4), gone)
    before = {bytes(r.digest): r.group_size for r in exact_dedup.members(stored).collect()}
    now = {bytes(r.digest): r.group_size for r in exact_dedup.members(after).collect()}
    assert set(before) - set(now) == {hashlib.sha256(b"x").digest()}
    ab = hashlib.sha256(b"ab").digest()
    assert now[ab] == before[ab] + 1


def test_mixing_meets_its_targets(spark, rows, docs):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(common.WORD, t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, bound, held = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, {}
    free = set(order)
    while True:
        level = (total - sum(held.values())) / sum(weights[s] for s in free)
        over = {s for s in free if bound[s] < level * weights[s]}
        if not over:
            break
        held |= {s: bound[s] for s in over}
        free -= over
    target = {s: held.get(s, level * weights[s]) for s in order}
    by_size = {sizes[s]: target[s] for s in order}
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)


def test_mixing_leaves_clashing_columns_alone(spark):
    names = ["__copy", "__source", "__rate", "__number", "__one", "__row"]
    docs = spark.createDataFrame([(1, "a b", "s", *range(6)), (2, "c d e", "t", *range(6))], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    mixed = mixing.mix(docs).collect()
    assert mixed and {tuple(r[n] for n in names) for r in mixed} == {(0, 1, 2, 3, 4, 5)}
    kept = exact_dedup.drop_copies(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in docs.collect())
    encoded = pieces.encode(docs.withColumn("variant", F.lit("old")).withColumn("piece_ids", F.lit("old")))
    assert sorted(encoded.columns) == sorted({*docs.columns, "variant", "piece_ids"} - {"text"}) and encoded.first()["__row"] == 5


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "HTTP://A.EXAMPLE.NET/de", "https://net", "http://x.org/fr/?q", "http://xorg/fr/", "no scheme", "", None, "http://b.example.com/de/1", "http://b.example.com/de",
            "https://www.casino-win.example.org/en/1", "https://spam-farm.example.org/", "http://example.net/en/x", "http://example.net/en/x", "a://b://c/d#e", "ftp://q.adult/adult/x"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, token string")

    def by_hand(u):
        after = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = "".join(c.lower() if c in common.UPPER else c for c in host)
        fit = [r for r in url_filter.SITE_RULES if re.search(r.pattern, host + path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        verdict = best.verdict if best else "block" if any(re.search(r.pattern, host + path) for r in url_filter.PATTERN_RULES) else "allow"
        return host, path, best.name if best else None, verdict

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {k: by_hand(u) for k, u in enumerate(urls)}
    assert got[0][2:] == ("example.net/en/", "allow") and got[2][2] is None and got[3][2:] == ("org/fr/", "allow") and got[4][2] is None
    assert all(r.tokens for r in url_filter.SITE_RULES + url_filter.PATTERN_RULES)
    # A rule's path is met as it is written, its tokens in lower case.
    upper = spark.createDataFrame([("Example.NET", "/En/x", "block"), ("a.b", "/q.*[\\E/", "block"), ("org", "/", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://w.example.net/En/x/y"), (2, "http://w.example.net/en/x"), (3, "x://a.b/q.*[\\E/1"), (4, "x://a.b/qq"), (5, "x://q.ORG/1")], "page_id long, url string")
    for table in (url_filter.site_rules(upper), tuple(url_filter.site_rule(*r) for r in upper.collect())):
        assert {r.page_id for r in url_filter.judge(urls, table).where("verdict = 'block'").collect()} == {1, 3, 5}
    listed = spark.createDataFrame([("digit", "block", "[0-9]x", None), ("far", "allow", "far", ["far"])], "name string, verdict string, pattern string, tokens array<string>")
    more = url_filter.site_rules(upper).unionByName(url_filter.pattern_rules(listed))
    found = spark.createDataFrame([(1, "x://h/1x"), (2, "x://far.y/"), (3, "x://a.b/q")], "page_id long, url string")
    assert [(r.verdict, r.pattern_rule) for r in url_filter.judge(found, more).orderBy("page_id").collect()] == [("block", "digit"), ("allow", "far"), ("allow", None)]
    loose = (url_filter.pattern_rule("any digit", "block", r"[0-9]"),)
    assert loose[0].tokens == ()
    assert {r.page_id for r in url_filter.judge(pages, loose).where("verdict = 'block'").collect()} == {8, 10}


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = [(1, "u1", "<p>a</p>"), (2, "u\n2", "<p>a</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "WARC/1.1\r\nx\r\n\r\n漢字"), (None, "u6", "<p>a</p>"), (7, "u7", "z" * 100000), (5, "u5", "WARC/1.1\r\nx\r\n\r\n漢字")]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "archives")
    warc.write(table, path)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in warc.read(spark, path).where("kind = 'record'").select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to").alias("refers_to")).collect())
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    wanted = Counter((i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), *(("response", None) if i == last[h or ""] else ("revisit", last[h or ""]))) for i, _, h in pages)
    assert got == wanted
    payloads = {r.record_id: bytes(r.payload).decode() for r in warc.read(spark, path).where("type = 'response'").collect()}
    assert payloads["<urn:page:7>"] == "z" * 100000


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (1 << 10, 1 << 13))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 14)
    sizes = [10] * 40 + [5000] * 7 + [30000] * 2
    rows = [(k, f"u{k}", f"{k:06}" + "x" * n) for k, n in enumerate(sizes)]
    path = str(tmp_path / "bounded")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    records = warc.read(spark, path).collect()
    assert sorted((r.record_id, bytes(r.payload).decode()) for r in records) == sorted((f"<urn:page:{k}>", h) for k, _, h in rows)
    held = Counter()
    for r in records:
        held[r.archive] += r.payload_bytes
    assert len(held) == 3 + 4 + 2 and all(n <= 1 << 14 or n > 30000 for n in held.values())


def record(n, payload):
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{warc.base32_sha1(payload)}\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n".encode()
    return head + http + payload + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_damage_is_skipped_and_logged(packed):
    parts = [gzip.compress(record(n, b"payload %d" % n)) if packed else record(n, b"payload %d" % n) for n in range(5)]
    bad = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    bad[at : at + 8] = b"\xff" * 8
    found = list(warc.salvage(b"junk" + bytes(bad)[:-3]))
    assert [x["record_id"] for x in found if x["kind"] == "record"] == [f"<urn:page:{n}>" for n in (0, 2, 3)]
    assert [(x["offset"], x["length"]) for x in found if x["kind"] == "gap"] == [(0, 4), (4 + len(parts[0]), len(parts[1])), (4 + sum(map(len, parts[:4])), len(parts[4]) - 3)]
    assert sum(x["length"] for x in found) == len(bad) + 1
    assert list(warc.salvage(b"")) == []


def test_warc_reads_long_headers_members_and_other_types(spark, tmp_path):
    def raw(kind, block, *more):
        return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *more, "", ""]).encode() + block + b"\r\n\r\n"

    http, page = b"HTTP/1.1 200 OK\r\n\r\n", b"<p>a</p>"
    parts = [
        raw("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        raw("response", http + page, "Content-Type: application/http; msgtype=response"),
        raw("response", http + page, "WARC-Payload-Digest: sha256:" + hashlib.sha256(page).hexdigest()),
        raw("response", http + page, "WARC-Payload-Digest: other:1"),
        raw("resource", b"plain", "Content-Type: text/plain"),
    ]
    wanted = [b"software: x\r\n", page, page, page, b"plain"]
    bad = raw("response", http + page, "WARC-Payload-Digest: sha256:" + "0" * 64)
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        found = list(warc.salvage(data))
        assert [x.get("payload") for x in found] == wanted and sum(x["length"] for x in found) == len(data)
    found = list(warc.salvage(gzip.compress(parts[0] + bad + parts[4])))
    assert [(x["kind"], x.get("reason")) for x in found] == [("record", None), ("gap", "payload digest"), ("record", None)]
    path = str(tmp_path / "long")
    warc.write(spark.createDataFrame([(1, "u" * 200000, "x")], "page_id long, url string, html string"), path)
    assert [r.kind for r in warc.read(spark, path).collect()] == ["record"]


@pytest.mark.parametrize(("order", "min_count", "heavy_share"), [(2, 2, katz.HEAVY), (2, 1, 64), (3, 1, 16), (3, 2, 1), (1, 1, 16)])
def test_katz_matches_the_recursion(rows, docs, order, min_count, heavy_share):
    """With a small heavy_share most keys go through the shuffle."""
    got = defaultdict(list)
    for r in katz.score_documents(docs, min_count, order, heavy_share).collect():
        got[r.doc_id].append(r)
    tokens = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    seen, texts = [Counter() for _ in range(order + 1)], 0
    for i, t, _ in rows:
        if not katz.held_out(i):
            w = ["<s>", *tokens(t)]
            seen[1].update(w[1:])
            for n in range(2, order + 1):
                seen[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            texts += 1
    words = seen[1]
    n, v = sum(words.values()), len(words)
    ratios = [None, *(katz.discounts(Counter(c.values())) for c in seen[1:])]
    part = lambda c, level: c * ratios[level][c - 1] if c <= katz.K else c
    kept = sum(part(c, 1) for c in words.values())
    over = n if n - kept > 1e-6 else n + 1
    p1, unknown = {w: part(c, 1) / over for w, c in words.items()}, 1 - kept / over
    after = defaultdict(list)
    for level in range(2, order + 1):
        for gram, c in seen[level].items():
            if c >= min_count:
                after[gram[:-1]].append((gram[-1], c))

    def total(h):
        size = texts if h == ("<s>",) else seen[len(h)][h if len(h) > 1 else h[0]]
        return size if size - sum(part(c, len(h) + 1) for _, c in after[h]) > 1e-6 else size + 1

    @functools.cache
    def alpha(h):
        if h not in after:
            return 1.0
        return (1 - sum(part(c, len(h) + 1) for _, c in after[h]) / total(h)) / (1 - sum(p(h[1:], w) for w, _ in after[h]))

    @functools.cache
    def p(h, w):
        if not h:
            return p1.get(w, unknown)
        c = seen[len(h) + 1][*h, w]
        return part(c, len(h) + 1) / total(h) if c >= min_count else alpha(h) * p(h[1:], w)

    for h in list(after)[:20] + list(after)[-20:]:
        assert sum(p(h, w) for w in words) + p(h, "never seen") == pytest.approx(1)
    for i, t, _ in rows:
        w = tokens(t)
        r = got[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in words for x in w), n, katz.held_out(i))
        padded = ["<s>", *w]
        logs = [math.log10(p(tuple(padded[max(0, k + 2 - order) : k + 1]) if order > 1 else (), x)) for k, x in enumerate(w)]
        assert r.score == pytest.approx(sum(logs), rel=1e-7)
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    assert sum(map(len, got.values())) == len(rows)


def test_discounts_stand_in_where_counts_are_thin():
    assert katz.discounts({}) == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    assert all(0 < d < 1 for d in katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}))


def test_toxicity_learns_pairs_and_held_out_labels(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(800):
        words = rng.choices([f"common{j}" for j in range(40)], k=20)
        kind = rng.randrange(4)
        words += [["filler"], ["insulting"], ["groupname"], ["insulting", "groupname"]][kind]
        rng.shuffle(words)
        rows.append((k, " ".join(words), "a"))
        labels.append((k, int(kind == 3)))
    labels += [(None, 1), (5000, 1), (3, None), (0, labels[0][1])]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(800) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k] >= toxicity.THRESHOLD) == bool(labels[k][1]) for k in held)
    assert right / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s < toxicity.THRESHOLD}


def test_toxicity_without_labels(spark, docs, rows):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score < 1e-9 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.drop_toxic(docs, model).count() == len(rows)


def test_scorer_matches_the_double_loop():
    text = "Abcdef abcdxx abcdyy ABCDzz ab 12 été"
    rng = np.random.default_rng(1)
    chosen = np.array(sorted(toxicity.terms(text) | {7, 8}))
    w, v = rng.normal(size=len(chosen)), rng.normal(size=(len(chosen), 3))
    there = [k for k, t in enumerate(chosen) if t not in (7, 8)]
    z = 0.5 + sum(w[k] for k in there) + sum(v[a] @ v[b] for a in there for b in there if a < b)
    assert toxicity.Scorer(toxicity.Model(0.5, chosen, w, v)).score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    assert toxicity.Scorer(toxicity.Model(0.5, chosen, w, v)).score(None) == pytest.approx(1 / (1 + math.exp(-0.5)))


def test_toxicity_learns_what_no_single_term_says(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(1600):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"common{j}" for j in range(40)], k=12) + ["aaa"] * one + ["bbb"] * two
        rows.append((k, " ".join(words), "a"))
        labels.append((k, int(one != two)))
    rows += [(None, "aaa", "a"), (1601, None, "a"), (1602, "", "a"), (1603, "aaa " * 50000, "a"), (1603, "aaa " * 50000, "a")]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (1601, 0), (1602, 0), (1603, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r.score)
    held = [k for k in range(1600) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k][0] >= 0.5) == bool(labels[k][1]) for k in held) / len(held)
    # Any sum of weights gets at most three of the four cases right.
    assert right > 0.95 and sum(map(len, got.values())) == len(rows) and got[1601] == got[1602] and len(got[1603]) == 2
    folds = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    assert {r.held for r in folds if r.doc_id is None} == {False}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns


def test_toxicity_sample_is_bounded_by_rows_and_terms(spark):
    rows = [(1, "same words here", "a")] * 50 + [(k, f"word{k} other{k}", "a") for k in range(2, 60)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, toxic int")
    hashed = spark.createDataFrame([(i, 1, list(range(5))) for i, _, _ in rows], "doc_id long, toxic int, terms array<int>")
    assert toxicity.sampled(hashed, 10, 1000).count() == 10 and toxicity.sampled(hashed, 1000, 22).count() == 4
    assert toxicity.sampled(hashed, 1000, 1000).count() == 59 and toxicity.sampled(hashed, 10, 2).count() == 0
    assert toxicity.train(frame(spark, rows), marks, sample=20).base != 0


def test_media_round_trip(rows, docs):
    got = defaultdict(list)
    for r in media.documents_with_media(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i][0]
        stored = media.encode(payload)
        assert media.decode(stored).tobytes() == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_sequences_keep_places_and_captions(spark):
    html = "<h1>T</h1><p>one<img src='sha256:a' alt='x'>two &amp; 3</p><figure><img src='sha256:b'><img src='c'><figcaption>cap <b>tion</b></figcaption></figure><script>no</script>end"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<img src='sha256:a'>")], "id long, html string")
    about = spark.createDataFrame([("sha256:a", 7)], "digest string, payload_bytes long")
    got = media.resolve(media.sequences(pages), "id", about).orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.kind, r.text or r.digest, r.caption, r.payload_bytes) for r in got] == [
        (1, 0, "text", "T", None, None), (1, 1, "text", "one", None, None), (1, 2, "media", "sha256:a", "x", 7), (1, 3, "text", "two & 3", None, None),
        (1, 4, "media", "sha256:b", "cap tion", None), (1, 5, "media", "c", "cap tion", None), (1, 6, "text", "end", None, None), (3, 0, "media", "sha256:a", None, 7),
    ]


def test_captions_stand_at_their_media_and_sequences_are_put_together(spark):
    parse = lambda html: [(x["pos"], x["text"] or x["digest"], x["caption"]) for x in media.Interleaved.parse(html)]
    assert parse("<figure><figcaption>cap</figcaption><img src=a><img src=b alt=x></figure>t") == [(0, "a", "cap"), (1, "b", "cap"), (2, "t", None)]
    assert parse("a<figure><figcaption>only</figcaption></figure>b") == [(0, "a", None), (1, "only", None), (2, "b", None)]
    assert parse("<figure><img src=a alt=own><figure><figcaption>in<p>ner</p></figcaption><img src=b></figure></figure>") == [(0, "a", "own"), (1, "b", "inner")]
    assert parse("<figure><img src=a><figcaption>open") == [(0, "a", "open")] and parse("<figcaption>no figure</figcaption>") == [(0, "no figure", None)]
    html = "<p>one</p><img src='sha256:a'><figure><figcaption>c</figcaption><img src='sha256:b'></figure><p>two</p>" * 6
    pages = spark.createDataFrame([(1, 5, html)], "id long, n int, html string")
    about = spark.createDataFrame([("sha256:a", 7), ("sha256:b", 8)], "digest string, payload_bytes long")
    whole = media.assembled(media.resolve(media.sequences(pages), ["id", "n"], about).repartition(5), ["id", "n"]).first()
    assert [(x.pos, x.text or x.payload_bytes, x.caption) for x in whole["items"]] == [(4 * k + j, *x) for k in range(6) for j, x in enumerate([("one", None), (7, None), (8, "c"), ("two", None)])]


def test_damaged_media_are_noticed():
    stored = bytearray(media.encode(media.padded(b"abc")))
    stored[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(stored))


def test_pieces_are_lossless_and_vary(rows, docs):
    got = pieces.round_trips(docs).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    again = {(r.doc_id, r.pieces_sha256) for r in pieces.round_trips(docs.repartition(1)).collect()}
    assert again == {(r.doc_id, r.pieces_sha256) for r in got}
    text = next(t for i, t, _ in rows if i == 20)
    encoder = pieces.Encoder(pieces.load(), 0.3)
    assert len({tuple(encoder.encode(text, v).tolist()) for v in range(4)}) > 1


def test_pieces_without_dropout_are_the_library_s(rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(pieces.load(), 0.0)
    for _, t, _ in rows:
        if t and pieces.MARK not in t and len(t) < 20000:
            assert encoder.encode(t).tolist() == library.encode(t)


def plain_pieces(encoder, text, variant):
    """Merge-dropout as it is defined, pair by pair over the whole text."""
    ids, ranks, key, skipped = encoder.v.ids, encoder.v.ranks, encoder.key(variant), set()
    # A mark of the text's own is hidden behind a zero, as it takes part in no merge.
    held = [(pieces.MARK, 0)] + [({" ": pieces.MARK, pieces.MARK: "\0" + pieces.MARK}.get(c, c), k) for k, c in enumerate(text, 1)]
    while True:
        pairs = [(ranks[ids[p]], held[k][1], k, p) for k in range(len(held) - 1) if (p := held[k][0] + held[k + 1][0]) in ids and (held[k][1], p) not in skipped]
        if not pairs:
            break
        _, place, k, piece = min(pairs)
        if encoder.skips(key, place, ids[piece]):
            skipped.add((place, piece))
        else:
            held[k : k + 2] = [(piece, place)]
    return [i for s, _ in held for i in ([ids[s]] if s in ids else [int(encoder.v.byte_ids[b]) for b in s.removeprefix("\0").encode()])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_pieces_match_a_plain_encoder(rows, dropout):
    encoder, small = pieces.Encoder(pieces.load(), dropout), pieces.Encoder(pieces.load(), dropout, window=7)
    rng = random.Random(2)
    texts = [t[:160] for _, t, _ in rows if t][::3] + ["▁a ▁▁ b", "international " * 9, "donaudampfschifffahrtsgesellschaft" * 3, "x" * 150, "\x01 \n\n é\u0301 😀😀 漢字", "a" * 70 + " " * 80]
    texts += ["".join(rng.choices("abcdeént \n▁", k=rng.randint(1, 200))) for _ in range(30)]
    for variant, text in enumerate(texts):
        wanted = plain_pieces(encoder, text, variant)
        assert encoder.encode(text, variant).tolist() == wanted == small.encode(text, variant).tolist()
        assert encoder.decode(wanted) == text.encode()
    all_at_once, sizes = encoder.encode_all(texts, list(range(len(texts))))
    assert all_at_once.tolist() == [x for k, t in enumerate(texts) for x in encoder.encode(t, k).tolist()] and sizes.sum() == len(all_at_once)


def test_dropout_varies_by_place_document_and_copy(spark):
    encoder = pieces.Encoder(pieces.load(), 0.1)
    word = " internationalisation"
    text, cuts, cut, size = (word * 400)[1:], set(), [], 0
    for piece in encoder.encode(text, 5).tolist():
        cut.append(piece)
        size += len(encoder.v.raw[piece])
        if size == len(word):
            cuts.add(tuple(cut))
            cut, size = [], 0
    assert not cut and len(cuts) > 8
    assert len({tuple(encoder.encode(text, encoder.variant(k)).tolist()) for k in range(40)}) == 40
    copies = spark.createDataFrame([(1, text, n) for n in range(6)], f"doc_id long, text string, {pieces.COPY} int")
    assert len({tuple(r.piece_ids) for r in pieces.encode(copies).collect()}) == 6


def test_a_long_text_without_blanks_is_settled_by_a_heap():
    encoder = pieces.Encoder(pieces.load(), 0.2)
    text = "".join(random.Random(3).choices("abenst", k=40000))
    ids = encoder.encode(text, 1)
    assert encoder.decode(ids.tolist()) == text.encode()
    short = encoder.encode(text[:400], 1).tolist()
    assert ids.tolist()[: len(short) - 20] == short[:-20]


def test_encode_and_decode_tables(rows, docs):
    encoded = pieces.encode(docs)
    back = pieces.decode(encoded)
    assert Counter(r.text for r in back.select("text").collect()) == Counter(t or "" for _, t, _ in rows)
    assert set(docs.columns) - {"text"} <= set(encoded.columns)


def fingerprint_by_hand(text, shingle=4):
    w = common.words(text)
    shingles = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(nodes, most=4):
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a] ^ nodes[b]).bit_count() <= most:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in range(len(nodes)):
        groups[root(x)].append(x)
    return groups.values()


def test_near_groups(rows, docs):
    marks = [fingerprint_by_hand(t) for _, t, _ in rows]
    wanted = Counter()
    for group in components(marks):
        least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        wanted.update((rows[x][0], f"{marks[x]:016x}", least) for x in group)
    assert Counter(tuple(r) for r in simhash.near_groups(docs).collect()) == wanted


@pytest.mark.parametrize("name", ["exact", "near"])
def test_pipeline_dedup_decides_by_row(spark, name):
    import corpus_pipeline

    other, lone = "one of its kind " * 9, "without an id " * 7
    rows = [(1, "same text here now " * 5, "a")] * 3 + [(None, "same text here now " * 5, "a")] * 2 + [(2, "same text here now " * 5, "b"), (2, other, "a")]
    rows += [(None, lone, "a"), (None, lone, "b"), (7, "x y z", "a"), (7, "x y z", "b")]
    kept = getattr(corpus_pipeline, name)(spark, frame(spark, rows), "")
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, rows[0][1]), (2, other), (None, lone), (7, "x y z")])
    assert kept.columns == frame(spark, rows).columns


def test_pipeline_near_stage_links_all_of_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(11)
    line = [f"line{k}" for k in range(12)]
    texts = ["", " ", "one", "one two", "x"]
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 20, 60, 150, 400]))]
        base += line if k % 2 else []
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    sets = [near.shingle_set(t.encode(), corpus_pipeline.SHINGLE) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            shared, union = len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))
            if 5 * shared >= 4 * union:
                parent[root(a)] = root(b)
                far += (simhash.fingerprint(texts[a].encode(), 5) ^ simhash.fingerprint(texts[b].encode(), 5)).bit_count() > 4
    groups = defaultdict(list)
    for x in range(len(texts)):
        groups[root(x)].append(x)
    kept = corpus_pipeline.near(spark, frame(spark, [(k, t, "a") for k, t in enumerate(texts)]), "")
    assert far > 20
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))


@pytest.mark.parametrize("run", [1 << 15, 3])
def test_links_join_all_that_is_linked(spark, run):
    rng = random.Random(3)
    nodes = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            nodes.add(x)
    nodes = sorted(nodes)
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    joined = {r.u: r.v for r in simhash.stars(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), run)).collect()}
    wanted = {frozenset(signed[x] for x in group) for group in components(nodes)}
    got = defaultdict(set)
    for x in signed:
        got[joined.get(x, x)].add(x)
    assert {frozenset(g) for g in got.values()} == wanted


def test_longer_keys_join_what_a_run_links():
    rng = random.Random(6)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        fps = np.array([a, b], np.uint64)
        for key in set(simhash.chain_keys(fps)[0]) & set(simhash.chain_keys(fps)[1]):
            keys = simhash.longer_keys(np.array([key, key]), fps)
            assert set(keys[0]) & set(keys[1]) and {int(k) & 7 for k in keys.ravel()} == {int(key) & 7}


def test_each_chain_keeps_every_pair_within_the_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        keys = simhash.chain_keys(np.array([a, b], np.uint64))
        shared = set(keys[0]) & set(keys[1])
        assert any(simhash._near(np.uint64(a), np.array([b], np.uint64), int(k) & 7)[0] for k in shared)


def test_empty_tables(spark, nothing):
    assert sharding.shard(nothing, "doc_id", "text").count() == 0
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert katz.score_documents(nothing).count() == 0
    assert toxicity.score(nothing, toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert media.documents_with_media(nothing).count() == 0
    assert pieces.round_trips(nothing).count() == 0 and pieces.encode(nothing).count() == 0
    assert simhash.near_groups(nothing).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_no_archive_of_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


def test_pipeline_stages(spark, rows, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(7, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    held = spark.read.parquet(f"{folder}/documents.parquet")
    names = held.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, held = held.collect(), common.stored(stage(spark, held, folder), "test-stage")
        assert held.columns == names
        if name == "exact dedup":
            groups = defaultdict(list)
            for r in before:
                groups[plain(r.text)].append((r.doc_id, r.text))
            assert {r.doc_id for r in held.collect()} == {best_of(g) for g in groups.values()}
        if name == "SimHash near-dedup":
            left = {r.doc_id for r in held.collect()}
            for group in components([fingerprint_by_hand(r.text, corpus_pipeline.SHINGLE) for r in before]):
                ids = [before[x].doc_id for x in group if before[x].doc_id is not None]
                assert len(left & set(ids)) == (1 if ids else 0)
    last = corpus_pipeline.run(spark, folder)
    assert last.count() > 0 and "piece_ids" in last.columns


def test_pipeline_on_empty_tables_and_null_labels(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    marks = "doc_id long, quality int, toxic int"
    long_text = "one long text of many words " * 20000
    for name, rows, labels in [
        ("empty", [], []),
        ("unlabelled", [(1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "", "en", "s", 0), (3, long_text, "en", "t", 1)], [(1, 1, None), (None, 1, 1), (9, None, 1)]),
    ]:
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, marks).write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # The null text and the empty one are copies, of which the row with an id stays; its
        # source has no words, so that the mix takes none of it.
        assert Counter(r.doc_id for r in got).keys() <= {1, 3} and (not rows or len(got) > 0)
        encoder = pieces.Encoder(pieces.load())
        texts = {1: "a b c d e f", 3: long_text}
        assert all(encoder.decode(r.piece_ids) == texts[r.doc_id].encode() for r in got)


def test_long_urls_are_judged(spark):
    url = "http://w.example.com/de/" + "x" * 300000
    pages = spark.createDataFrame([(1, url), (1, url), (2, "http://" + "a." * 50000 + "example.net/en/")], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict, len(r.path)) for r in url_filter.judge(pages).collect())
    assert got == {(1, "example.com/de/", "block", 300004): 2, (2, "example.net/en/", "allow", 4): 1}
