"""SimHash, fingerprints, licenses and decontamination against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, prose
from weft.llm import components, decontamination, fingerprints, licenses, simhash


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_brute_force():
    rng = random.Random(2)
    for t in [t or "" for _, t in ODD if len(t or "") < 1000] + [prose(rng, n) for n in (1, 2, 3, 4, 300)] + ["A B c A b C a b c\x0bd"]:
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(40)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = groups(sorted(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    for large in (2, 64):  # with and without the way for large buckets
        links = simhash.links(df, large)
        assert all(((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 2 for r in links.collect())
        got = {r["u"]: r["m"] for r in components.components(links).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)], "u long, v long")
    assert {r["u"]: r["m"] for r in components.components(edges).collect()} == {i: 0 for i in range(1, 41)}
    assert components.components(edges.limit(0)).count() == 0


def test_linked_rows(docs, empty):
    rows = docs.collect()
    got = simhash.linked(docs).collect()
    fp = {r["doc_id"]: slow_fingerprint(r["text"] or "") for r in rows if len(r["text"] or "") < 50_000}
    assert len(got) == len(rows) and all(r["fingerprint"] == f"{fp[r['doc_id']]:016x}" for r in got if r["doc_id"] in fp)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[901] == of[902] == of[903] == 901 and of[906] == 906 and of[None] is None
    assert simhash.linked(empty).count() == 0


def edited(rng, text, share):
    return " ".join("zz" + w if rng.random() < share else w for w in text.split())


def test_one_of_each(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, 300)) for i in range(40)]
    near = [(100 + i, t[:-40] if i % 2 else t.replace(" ", "  ", 3)) for i, t in rows[:20]]  # similarity over 0.9
    far = [(200 + i, edited(rng, t, 0.2)) for i, t in rows[20:]]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows + near + far], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i, _ in rows} | {i for i, _ in far}
    out = simhash.one_of_each(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and ids.count(906) == 1 and ids.count(None) == 1 and len({901, 902, 903} & set(ids)) == 1
    assert simhash.one_of_each(empty).count() == 0


def like(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_edits_in_one_piece_are_near_copies(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 300)) for i in range(120)]
    near = []
    for i, t in rows:
        w, new = t.split(), prose(rng, 30).split()
        near.append((1000 + i, " ".join([w[:246], w + prose(rng, 70).split(), w[:130] + new[:28] + w[158:]][i % 3])))
    assert all(0.8 <= like(t, n) < 0.84 for (_, t), (_, n) in zip(rows, near))
    df = spark.createDataFrame(rows + near, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i, _ in rows}


def test_shingles_decide_near_copies(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, 300)) for i in range(120)]
    cuts = [(1000 + i, " ".join(t.split()[:n])) for i, t in rows for n in [241 if i % 2 else 238]]  # 0.8007 and 0.7905
    df = spark.createDataFrame(rows + cuts, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i, _ in rows} | {1000 + i for i, _ in rows if i % 2 == 0}


def test_near_copies_equal_brute_force(spark):
    """A passage that all texts share, chains of edits, lengths from 1 word up: the groups are those of all pairs."""
    rng = random.Random(16)
    passage = prose(rng, 60)
    texts = [passage + " " + prose(rng, rng.randrange(5, 40)) for _ in range(70)] + [prose(rng, rng.randrange(1, 60)) for _ in range(30)]
    for _ in range(60):  # each an edit of any before it, so groups are chains
        w = rng.choice(texts).split()
        at = rng.randrange(len(w))
        texts.append(" ".join(w[:at] + prose(rng, rng.randrange(1, 4)).split() + w[at + rng.randrange(3) :]))
    texts += [texts[3], "", " ", None]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    linked = 0
    for i, a in enumerate(grams):
        for j in range(i):
            if not a and not grams[j] or a and len(a & grams[j]) >= 0.8 * len(a | grams[j]):
                linked += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert linked > 40
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {top(i) for i in range(len(texts))}


def edits_of(rng, base, least, most):
    """The text with so many of its words changed, dropped or doubled."""
    w = base.split()
    for k in rng.sample(range(len(w)), rng.randrange(least, most)):
        w[k] = rng.choice([prose(rng, 1), prose(rng, 1), "", w[k] + " " + w[k]])
    return " ".join(w)


def test_edits_of_one_template_are_not_paired(spark, monkeypatch):
    """Most pairs of a large family lie below the similarity: what is compared grows with its size, not with the square."""
    compared = []
    inner = simhash.confirmed

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return inner(pairs, *rest)

    monkeypatch.setattr(simhash, "confirmed", counted)
    rng = random.Random(17)
    base = prose(rng, 150)
    texts = [base] + [edits_of(rng, base, 1, 8) for _ in range(600)]
    groups_of = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(compared) < 40 * len(texts)
    assert classes_of(groups_of) == slow_classes(texts)


def classes_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r["root"], set()).add(r["doc_id"])
    return sorted(map(sorted, by.values()))


def slow_classes(texts, similarity=0.8):
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    of = groups(range(len(texts)), lambda i, j: len(grams[i] & grams[j]) >= similarity * len(grams[i] | grams[j]))
    by = {}
    for i, r in of.items():
        by.setdefault(r, []).append(i)
    return sorted(by.values())


def test_large_buckets_equal_brute_force(spark):
    """Nested templates, cuts at both ends and texts without words, with buckets over 5 taken for large ones."""
    rng = random.Random(18)
    base = prose(rng, 120)
    words = base.split()
    other = " ".join(words[:100] + prose(rng, 30).split())
    texts = [edits_of(rng, base, 0, 7) for _ in range(60)] + [edits_of(rng, other, 0, 7) for _ in range(60)]
    texts += [" ".join(words[rng.randrange(12) : len(words) - rng.randrange(50)]) for _ in range(40)]
    texts += [edits_of(rng, rng.choice(texts), 1, 4) for _ in range(40)] + ["", " ", "\n", prose(rng, 3), prose(rng, 60)]
    texts = list(dict.fromkeys(texts))
    want = slow_classes(texts)
    assert 20 < len(want) < len(texts) - 40
    assert classes_of(simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), large=5).collect()) == want


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprinted(docs)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        e = t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    held = got.collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in held), key=repr) == sorted(want, key=repr)
    plain = [r for r in held if r["doc_id"] is not None and 0 < r["doc_id"] <= 59]
    assert sum(r["near_edited"] for r in plain) / len(plain) > 0.6 > 0.2 > sum(r["near_next"] for r in plain) / len(plain)
    by = {r["doc_id"]: r for r in held}
    assert by[901]["fingerprint"] == by[902]["fingerprint"] == "0" * 16 and by[50]["n_within"] == 1 and by[51]["n_within"] is None
    assert fingerprints.fingerprinted(empty).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_order_in_buckets(spark, rows):
    ids = [None, 5, 5, 9, 12, 40, 41, 42, 1000, 1 << 40]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in fingerprints.in_order(df, rows).filter("not ghost").collect()}
    assert got == {f"t{k}": f"t{(k + 1) % len(ids)}" for k in range(len(ids))}


def test_within_equals_brute_force(spark):
    rng = random.Random(6)
    base = rng.getrandbits(63)
    fps = list({base ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(7))) for _ in range(80)})
    got = {(r["q"], r["fp"]) for r in fingerprints.within(spark.createDataFrame([(f,) for f in fps], "fp long"), spark.createDataFrame([(f,) for f in fps[:20]], "q long")).collect()}
    assert got == {(a, b) for a in fps[:20] for b in fps if (a ^ b).bit_count() <= 3}


def slow_licenses(text, least=0.8):
    words, out = [w for w in re.split(r"[^\w]+|_", text.lower()) if w], {}
    for name, notice in licenses.TEMPLATES.items():
        t = licenses.Template(name, tuple(w for w in re.split(r"[^\w]+|_", notice.lower()) if w))
        n = max(5, len(t.words)) + 2 * licenses.step_of(max(5, len(t.words)))
        have = lambda b: {" ".join(words[i : i + 5]) for i in range(b, min(b + n, len(words)) - 4)}
        best = max((len(set(t.shingles) & have(b)) / len(t.shingles) for b in range(max(1, len(words)))), default=0)
        if best >= least:
            out[name] = best
    return out


def test_licenses(spark, docs, empty):
    rng = random.Random(7)
    rows = []
    for k, notice in enumerate(licenses.TEMPLATES.values()):
        rows.append((k, prose(rng, rng.randrange(30)) + "\n" + notice + "\n" + prose(rng, rng.randrange(30))))
        words = notice.split()
        words[len(words) // 3] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "licensed"), (303, "the license of licensed licenses " * 50), (304, (prose(rng, 500) + " Released under the MIT License. ") * 3)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scanned(df).collect()}
    want = {(i, n): s for i, t in rows for n, s in slow_licenses(t or "").items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) or want[k] < 1 for k in got)
    assert licenses.scanned(docs).count() == 0 and licenses.scanned(empty).count() == 0


def test_long_template(spark):
    rng = random.Random(25)
    notice = prose(rng, 230).split() + ["licensee", "grants"] + prose(rng, 20).split()
    at = lambda part, gap: prose(rng, 90) + " " + " ".join(notice[: int(len(notice) * part)][:gap] + notice[: int(len(notice) * part)][gap + 1 :]) + " " + prose(rng, 40)
    rows = [(1, at(1, 1000)), (2, at(0.9, 1000)), (3, at(0.7, 1000)), (4, at(1, 100)), (5, prose(rng, 400))]
    got = {r["doc_id"]: r["containment"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), {"long": " ".join(notice)}).collect()}
    grams = [tuple(notice[i : i + 5]) for i in range(len(notice) - 4)]
    for i, text in rows:
        own = {tuple(text.split()[k : k + 5]) for k in range(len(text.split()) - 4)}
        share = sum(g in own for g in grams) / len(grams)
        assert (i in got) == (share >= 0.8) and (i not in got or abs(got[i] - share) < 1e-9)


def test_contamination(spark, docs, empty):
    rng = random.Random(8)
    items = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(3)) + ".") for i in range(12)]
    hosts = [(i, prose(rng, 200)) for i in range(30)]
    leaks = []
    for i, t in items[:8]:
        words = t.split()
        if i % 2:
            for k in range(2, len(words) - 14, 6):  # a paraphrase that keeps the answer
                words[k] = "altered"
        leaks.append((100 + i, prose(rng, rng.randrange(5, 90)) + "\n" + " ".join(words).upper() + "\n" + prose(rng, 30)))
    more = [(20, None), (21, ""), (None, items[0][1]), (22, "too short")]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items + more], "item_id long, text string, share double")
    df = spark.createDataFrame([(i, t, 2) for i, t in hosts + leaks] + [(200, None, 1), (None, items[3][1], 1)], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(8)} | {(None, 3)}
    left = decontamination.clean(df, bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in hosts} | {200} and left.columns == df.columns
    assert decontamination.contaminated(docs, bench).count() == 0 and decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.clean(df, bench.limit(0)).count() == df.count()


def test_paraphrase_that_keeps_common_words(spark):
    rng = random.Random(12)
    common = [f"common{k}" for k in range(10)]
    item = " ".join(f"rare{k} {common[k]}" for k in range(6)) + " rare6 rare7 rare8 rare9. " + " ".join(common[6:]) + "."
    docs = [(i, prose(rng, 60) + (" " + " ".join(common) if i < 15 else "")) for i in range(200)]
    leak = prose(rng, 30) + " " + re.sub("rare", "other", item) + " " + prose(rng, 30)
    df, bench = spark.createDataFrame([*docs, (500, leak)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(df, bench).collect()}
    assert got[500]["share"] == 0.5 and not got[500]["copy"]


def test_items_beyond_the_dimensions_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontamination.prepared, "__defaults__", (4,))
    rng = random.Random(13)
    common = [prose(rng, 30, "bcdfg") for _ in range(5)]
    items = [(i, common[i % 5]) for i in range(30)] + [(99, prose(rng, 30))]  # the last lies outside the first 4 directions
    df = spark.createDataFrame([(i, prose(rng, 60, "klmpq")) for i in range(60)] + [(60, items[-1][1])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(60, 99)}


def test_finds_equal_brute_force(spark):
    """Every window of every text against every item by the longest common subsequence alone."""
    rng = random.Random(24)
    items = [(i, ". ".join(prose(rng, rng.randrange(5, 22)).capitalize() for _ in range(2)) + ".") for i in range(25)]
    docs = []
    for i in range(120):
        text = prose(rng, rng.randrange(1, 150)).split()
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            kept = [x if rng.random() < (0.55, 0.8, 1.0)[i % 3] or k > len(w) - 8 else prose(rng, 1) for k, x in enumerate(w)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = kept
        docs.append((i, " ".join(text)))
    want = {}
    for d, text in docs:
        words = decontamination.words_of(text)
        for i, t in items:
            own, answer = decontamination.words_of(t), decontamination.answer_of(t)
            n = decontamination.window_of(len(own))
            for b in range(0, max(1, len(words) // 16 + 1 - n // 16 + 1) * 16, 16):
                near = words[max(0, b - 16) : b + n + 16]
                share = decontamination.lcs(own, near) / len(own)
                if share >= 0.8 or share >= 0.5 and decontamination.lcs(answer, near) >= 0.8 * len(answer):
                    want[d, i] = max(share, want.get((d, i), 0))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.contaminated(df, bench).collect()}
    assert len(want) > 40 and any(s < 0.7 for s in want.values()) and got == want


def test_short_items_are_found_by_their_words(spark):
    docs = [(1, "We ask: who wrote Hamlet, and when?"), (2, "who ever wrote Hamlet"), (3, "Who wrote Hamlet"), (4, "hamlet"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "?!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["share"], r["first_word"], r["copy"]) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(1, 1, 1.0, 2, True), (3, 1, 1.0, 0, True)}
    assert {r["doc_id"] for r in decontamination.clean(df, bench).collect()} == {2, 4, 5}


def test_lcs():
    rng = random.Random(9)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(a, b) == t[-1][-1]
