"""Conversation repair, line deduplication and hard-negative mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import common, hard_negatives, line_dedup, repair
from loam.operators import ordinals

TURNS = "conv_id long, turn long, role string, text string, at long, letter string, conv string, block int, piece string"


def turns_frame(spark, rows):
    """conversations with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", "c", 2, "p") for r in rows], TURNS).repartition(3)


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        conv, key = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{conv}:{key}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


LEADS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def repaired(rows):
    """Cheapest edits by a forward search that holds the least (cost, audit) of each state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(common.SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    def better(best, state, way):
        if state is not None and (state not in best or way[:2] < best[state][:2]):
            best[state] = way

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    better(best, LEADS[state].get(role[0]), (cost + 3, audit + "I", (*out, (role, ""))))
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, out) in inserted(best).items():
            better(after, state, (cost + 4, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                cost += 3 if fault else 0
                better(after, LEADS[state].get(role[:1]), (cost, audit + "K", (*out, (role, text))))
                for other in ("user", "assistant"):
                    better(after, LEADS[state].get(other[0]), (cost + 3, audit + "R", (*out, (other, text))))
        best = after
    cost, audit, out = min((way for state, way in inserted(best).items() if state in ("", "a")), key=lambda w: w[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def test_repair_matches_a_forward_search(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut", "", " \n", None, "a. b", "Why? ", "漢。", "x" * 20000 + "."]
    rows = [
        (conv, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", "uncle", None]), rng.choice(texts))
        for conv in [None, *range(40)]
        for _ in range(rng.randint(1, 9))
    ]
    # A conversation of a third of the rows, and one whose only turn goes.
    rows += [(77, k // 2, "ua"[k % 2] + "x", f"t{k % 150}{'.!x'[k % 3]}") for k in range(300)]
    lost = next(k for k in range(100, 1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "gone.")]
    frame = turns_frame(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(frame, repair.damaged(frame)).collect()}
    wanted = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        assert found == repaired(wanted[" " if conv is None else str(conv)])
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_right_conversations(spark):
    frame = turns_frame(spark, [(k % 7, k, "sua?"[k % 4], f"t{k}.") for k in range(90)])
    rows = ordinals.placed(repair.damaged(frame).select("conv", "turn", "role", "text"), ["conv", "turn", "role", "text"])
    _, pieces = repair.edits(repair.marked(rows))
    read = defaultdict(str)
    for r in repair.rewritten(rows, pieces).select("conv", F.monotonically_increasing_id().alias("k"), "role").orderBy("k").collect():
        read[r["conv"]] += r["role"][:1]
    assert len(read) == 7
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in read.values())


def test_blocks_give_the_costs_of_one_backward_pass():
    rng = random.Random(1)
    for _ in range(50):
        letters = "".join(rng.choices("suaoSUAO1234", k=rng.randint(1, 40)))
        cut = rng.randint(0, len(letters))
        whole = repair.END
        for c in reversed(letters):
            whole = repair._before(c, whole)
        v = repair.END
        for block in (letters[cut:], letters[:cut]):
            m = repair.transfer(block)
            v = tuple(min(m[4 * a + b] + v[b] for b in range(4)) for a in range(4))
        assert v == whole


def test_repair_of_nothing(spark):
    frame = turns_frame(spark, [])
    assert repair.repair(frame, repair.damaged(frame)).collect() == []


DOCS = "doc_id long, text string, source string, hash string, lines int, place int, keeper long, documents int, drops int, kept int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "h", 1, 2, 3, 4, 5, 6) for i, t in rows], DOCS).repartition(3)


def deduplicated(rows, points, documents):
    key = lambda x: x.strip(common.SPACES).translate(str.maketrans(common.UPPER, common.LOWER))
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        drop = lambda x: len(key(x)) >= points and len(held[key(x)]) >= documents and i != max((y for y in held[key(x)] if y is not None), default=None)
        kept = [x for x in lines if not drop(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines_of_many_documents_go_but_once(spark):
    rng = random.Random(2)
    pool = ["A common line, HERE", " a common line, here\t", "short", "", "\r", "Éa common lInE with marks", "漢字" * 12, "x" * 30000]
    rows = [(None, None), (1, ""), (2, "\n"), (3, "only once in the corpus\n\n"), (4, "a common line, here")]
    rows += [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 12)))) for k in range(5, 60)]
    rows += [(None, "a common line, here\nx"), (None, "A COMMON LINE, HERE"), rows[20], (59, "a common line, here\nbut other text")]
    got = Counter(map(tuple, line_dedup.deduplicated(docs_frame(spark, rows), 10, 5).collect()))
    assert got == deduplicated(rows, 10, 5)
    assert line_dedup.deduplicated(docs_frame(spark, [])).collect() == []
    only = [(None, "a line without any holder's id")] * 6
    assert Counter(map(tuple, line_dedup.deduplicated(docs_frame(spark, only), 10, 5).collect())) == deduplicated(only, 10, 5)


def test_line_dedup_runs_no_python(spark):
    import contextlib
    import io

    with contextlib.redirect_stdout(shown := io.StringIO()):
        line_dedup.deduplicated(docs_frame(spark, [(1, "x")])).explain()
    assert "Python" not in shown.getvalue() and "Arrow" not in shown.getvalue()


def mined(rows):
    kept = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v, float))) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, _, v in kept)
    kept = [(i, y, np.pad(v, (0, width - len(v)))) for i, y, v in kept]
    out = Counter()
    for k, (anchor, label, vector) in enumerate(kept):
        if anchor % 50 == 0:
            scored = [(-int(v @ vector), i, y) for j, (i, y, v) in enumerate(kept) if j != k]
            for p, positive, _ in sorted(x for x in scored if x[2] == label)[:5]:
                window = sorted(x for x in scored if x[2] != label and -50 * p <= -100 * x[0] <= -95 * p)[:3]
                out.update((anchor, positive, rank, n, -p, -s) for rank, (s, n, _) in enumerate(window, 1))
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int, q long, unit long, score long, ids string, window int, rank int, key string, size int"


def embeddings_frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, 3, "i", 4, 5, "k", 6) for i, v, y in rows], EMBEDDINGS).repartition(3)


@pytest.mark.parametrize("dims", [3, 20])
def test_hard_negatives_match_a_full_search(spark, monkeypatch, dims):
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "DEAL", 4)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims))
    vector = lambda k: (centres[k % 6] + 0.3 * rng.normal(size=dims)).astype("float32").tolist()
    rows = [(k, vector(k), int(rng.integers(0, 4))) for k in range(400)]
    copied = vector(1)
    rows += [(k, copied, k % 2) for k in range(400, 700)]  # a vector of a third of the rows
    rows += [(None, vector(0), 1), (701, None, 1), (702, vector(0), None), (703, [float("nan")] * dims, 1), (704, [1.0, None, 1.0], 1), (705, [float("inf")], 1)]
    rows += [(750, [], 1), (800, [0.0] * dims, 2), (850, [1.0], 3), (900, vector(2), 8), rows[50], rows[50], rows[450], (50, vector(3), 1)]
    got = Counter(map(tuple, hard_negatives.mine(embeddings_frame(spark, rows)).collect()))
    assert got == mined(rows)
    assert got


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(embeddings_frame(spark, [])).collect() == []


def test_index_finds_all_above_and_leaves_dimensions_out():
    rng = np.random.default_rng(4)
    vectors, queries = np.floor(100 * rng.normal(size=(500, 37)) * np.linspace(0.1, 2, 37)), np.floor(100 * rng.normal(size=(30, 37)))
    vectors[:20] = 0
    norms = np.linalg.norm(queries, axis=1)
    for share in (0.05, 0.3, 0.6, 1.5):
        least = share * norms * np.linalg.norm(vectors, axis=1).max()
        index = hard_negatives.Index(vectors, float((least / norms).min()))
        q, u, scores = index.ask(queries, least)
        full = queries @ vectors.T
        assert {(a, b): s for a, b, s in zip(q.tolist(), u.tolist(), scores.tolist(), strict=True)} == {(a, b): full[a, b] for a, b in zip(*map(np.ndarray.tolist, np.nonzero(full >= least[:, None])), strict=True)}
        assert index.held[0] < len(vectors) - 20 and (index.held[-1] > 0) == (share < 1)
