"""Operators against plain restatements of what they should give."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import bpe, exact_dedup, html_extract, lang_id, lm_score, mixing, pii, simhash, substring_dedup, topk

WORDS = "the of and river stone bread light morning over under seven grind wheel slow water mill".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# op9


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact_wanted(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower_az(text), []).append(doc_id)
    return sorted((d, max(groups[lower_az(t)]), len(groups[lower_az(t)]), d == max(groups[lower_az(t)]), hashlib.sha256(lower_az(t).encode()).hexdigest()) for d, t in rows)


def exact_rows(seed=1):
    rng = random.Random(seed)
    texts = ["", None, " ", "É", "é", "ABC", "abc", "Straße", "x" * 30_000, "x" * 30_001, "X" * 30_000] + [" ".join(prose(rng, 30) for _ in range(rng.randint(1, 120))) for _ in range(15)]
    texts += [t.upper() if t and rng.random() < 0.5 else t for t in texts] + ["hot copy"] * 200
    return list(enumerate(texts))


def test_exact_dedup(spark):
    rows = exact_rows()
    got = sorted(tuple(r) for r in exact_dedup.exact_duplicates(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == exact_wanted(rows)


def test_exact_dedup_with_clashing_addresses(spark):
    """If every chunk had one of two addresses, results would be the same."""
    rows = exact_rows(2)
    got = exact_dedup.exact_duplicates(docs(spark, rows), hasher=lambda c: F.length(c).cast("long") % 2)
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact_wanted(rows)


def test_exact_keep_one(spark):
    rows = exact_rows(3)
    kept = {r[0] for r in exact_dedup.keep_one_of_each(docs(spark, rows)).collect()}
    assert kept == {r[0] for r in exact_wanted(rows) if r[3]}


def test_exact_keep_one_where_rows_share_an_id(spark):
    rows = [(1, "a text"), (1, "other"), (2, "A text"), (None, "other"), (3, "last"), (1, "last"), (4, None), (5, "")]
    kept = exact_dedup.keep_one_of_each(docs(spark, rows)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "other"), (2, "A text"), (3, "last"), (5, "")], key=str)


# op6


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_wanted(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((d, f"{p:016x}", least[find(k)]) for k, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def test_simhash(spark):
    rng = random.Random(4)
    texts = ["", None, "one", "One", "two words", " nbsp is no blank", "tab\tand\nline\x0bbreaks\x0cand\rmore"]
    for _ in range(25):
        base = prose(rng, 400).split()
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(WORDS)
            texts.append(" ".join(base))
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs(spark, rows)).select("doc_id", "fingerprint", "component_id").collect())
    wanted = components_wanted(rows)
    assert got == wanted
    assert len({r[2] for r in wanted}) < len(rows) - 10


def test_simhash_links_and_chains(spark):
    """Every pair within two bits links, three bits do not, and long chains hold together."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = [base ^ (1 << a) ^ (1 << b) for a, b in ((0, 1), (62, 63), (5, 5))]
    chain = [rng.getrandbits(64)]
    for k in range(40):
        chain.append(chain[-1] ^ (3 << k))
    far = [base ^ 7 << 20]
    values = list(dict.fromkeys(near + chain + far + [base]))
    signed = [v - (1 << 64) * (v >> 63) for v in values]
    links = simhash.edges(spark.createDataFrame([(v,) for v in signed], "print long"))
    from quernstone.llm.work import Work

    found = {r[0]: r[1] for r in simhash.components(links, Work(spark, "test")).collect()}
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a != b and (a ^ b).bit_count() <= 2:
                root[find(signed[values.index(a)])] = find(signed[values.index(b)])
    groups = {}
    for v in signed:
        groups.setdefault(find(v), []).append(v)
    for members in groups.values():
        assert {found.get(m) for m in members} == ({min(members)} if len(members) > 1 else {None})


def test_simhash_keep_one_where_rows_share_an_id(spark):
    rng = random.Random(27)
    a, b = prose(rng, 300), prose(rng, 300)
    rows = [(5, a), (5, b), (3, b.upper()), (None, a), (7, a), (8, "short"), (8, "short"), (9, None)]
    kept = simhash.keep_one_of_each(docs(spark, rows)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, a), (3, b.upper()), (8, "short"), (8, "short"), (9, None)], key=str)


def test_many_dropped_ids_are_joined_by_a_shuffle(spark, monkeypatch):
    from quernstone.llm import work

    rows = [(k, f"text {k // 3}") for k in range(60)] + [(60, "text 1"), (60, "of its own")]
    few = sorted(map(tuple, exact_dedup.keep_one_of_each(docs(spark, rows)).collect()))
    assert len(few) == 21
    monkeypatch.setattr(work, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, exact_dedup.keep_one_of_each(docs(spark, rows)).collect())) == few


# op7


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.2, 7)]) for k in range(400)] + [(400, None), (401, [1.0, float("nan")]), (402, [float("inf")]), (403, []), (404, [None, 1.0]), (405, [0.0] * 7), (50, [0.1] * 7), (None, [0.3] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r[0], []).append((r[1], r[2], r[3]))
    assert set(got) == {i for i, _ in good if i % 50 == 0}
    for i, q in good:
        if i in got:  # rows that repeat an id ask together
            scored = sorted((-int(a @ v), j) for b, a in good if b == i for j, v in good if j != i)[:5]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(scored)]


def test_top_k_of_few(spark):
    table = spark.createDataFrame([(0, [1]), (1, [2]), (2, [2])], "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in topk.top_k(table, table.where("vec_id = 0")).collect()) == [(0, 1, 1, 2), (0, 2, 2, 2)]


def test_top_k_of_wide_components(spark):
    """Scores beyond what doubles hold are exact; those beyond 64 bits are an error."""
    rng = random.Random(26)
    rows = [(k, [rng.randrange(-(10**9), 10**9) for _ in range(6)]) for k in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    for i, q in [r for r in rows if r[0] % 50 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:5]
        got = sorted(tuple(r)[1:] for r in topk.top_k(table, table.where(f"vec_id = {i}")).collect())
        assert got == [(k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    lists = topk.SortedLists(np.arange(3), np.array([[1 << 40, 5], [1 << 39, 7], [3, 1 << 41]]))
    with pytest.raises(OverflowError):
        lists.top(np.array([9]), np.array([[1 << 40, 0]]), 2)
    assert lists.top(np.array([9]), np.array([[1 << 22, 1]]), 1) == [(9, 0, (1 << 62) + 5)]


def brute_top(ids, vectors, asked, k):
    scores = vectors @ vectors[asked].T
    return sorted((int(ids[q]), int(ids[x]), int(scores[x, j])) for j, q in enumerate(asked) for x in sorted((x for x in range(len(ids)) if x != q), key=lambda x: (-scores[x, j], ids[x]))[:k])


def test_sorted_lists_stop_early():
    """Bounds hold, and on clustered vectors nearly all queries stop before the lists end."""
    rng = np.random.default_rng(7)
    centres, of = rng.normal(0, 1, (40, 16)), rng.integers(0, 40, 4000)
    vectors = np.floor(256 * (centres[of] + rng.normal(0, 0.05, (4000, 16)))).astype(int)
    lists, asked = topk.SortedLists(np.arange(4000), vectors), np.arange(0, 4000, 100)
    exact = vectors @ vectors[asked].T
    for depth in (100, 1000, 3000, 4000):
        low, high = lists._bounds(np.maximum(vectors[asked], 0).astype(float), np.minimum(vectors[asked], 0).astype(float), depth)
        assert (low <= exact).all() and (high >= exact).all()
    assert sorted(lists.top(asked, vectors[asked], 5)) == brute_top(np.arange(4000), vectors, asked, 5)
    assert sum(lists.stops.values()) == 40
    assert lists.stops.get(1.0, 0) <= 4 and sum(n for part, n in lists.stops.items() if part <= 0.5) >= 20
    few = np.where(rng.random((4000, 32)) < 0.1, rng.integers(1, 999, (4000, 32)), 0)
    lists = topk.SortedLists(np.arange(4000), few)
    assert sorted(lists.top(asked, few[asked], 5)) == brute_top(np.arange(4000), few, asked, 5)
    assert sum(n for part, n in lists.stops.items() if part <= 0.125) >= 30


# op5

ALPHABET = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "7", "%", "the", " the", "ion", "\t", "日本", "\U0001f600", "'", "aaaa", "\x85", "\x1c", " "]


@pytest.fixture(scope="module")
def core():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf,piece", [(1, 2), (3, 4), (8, 8), (64, 32), (2048, 4096)])
def test_bpe_is_the_librarys(core, leaf, piece):
    ranks, library = core
    rng, own = random.Random(leaf), bpe.Encoder(ranks, public_tokenizers.PATTERN, leaf, piece)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50)))
        ids = own.ids(text)
        assert ids == library.encode_ordinary(text), text
        assert own.decoded(ids).decode() == text


def test_bpe_of_long_matches(core):
    ranks, library = core
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(8)
    for text in ("a" * 20_000, "x y" * 9000, " " * 20_000 + "b", "".join(rng.choice("abcdefgh") for _ in range(30_000)), "é" * 9000):
        assert own.ids(text) == library.encode_ordinary(text)


def test_bpe_tables(spark, core):
    _, library = core
    rows = [(1, "Grind the corn."), (2, None), (3, ""), (None, "no id"), (1, "Grind the corn.")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode_table(docs(spark, rows), path, public_tokenizers.PATTERN).collect()
    assert len(found) == 5
    for r in found:
        text = {1: "Grind the corn.", None: "no id"}.get(r["doc_id"], "")
        ids = library.encode_ordinary(text)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_table(bpe.encode_table(docs(spark, rows), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(bytes(r["data"]).decode() for r in back.collect()) == ["", "", "Grind the corn.", "Grind the corn.", "no id"]


# op3


def base_wanted(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        odd = sum(map(int, digits[-1::-2])) + sum(sum(map(int, str(2 * int(x)))) for x in digits[-2::-2])
        if 14 <= len(digits) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


PARTS = ["a", "1", "22", ".", "@", "-", " ", "+", "(", ")", "255", "4111111111111111", "b.c", "é", "a@b.c", ",", "+1 (743) 555-3824", "10.0.0.1"]


def test_pii_base(spark):
    rng = random.Random(9)
    texts = [None, "", *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(3000))]
    for row in pii.find_personal_data(docs(spark, list(enumerate(texts)))).collect():
        wanted = base_wanted(texts[row["doc_id"]])
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in wanted) for k in range(4)]
        assert row["base_sha256"] == hashlib.sha256(pii.joined(wanted).encode()).hexdigest()
        spans = set(filter(None, row["spans"].split(",")))
        assert spans >= set(filter(None, pii.joined(wanted).split(",")))


def test_pii_of_hostile_texts_takes_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "+1" * 150_000, "1." * 150_000, "+1" + " " * 300_000):
        base = pii.base_spans(text)
        pii.wide_spans(text, base)


def test_pii_learns_other_writing(spark):
    rng = random.Random(10)
    rows, k = [], 0
    for _ in range(300):
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows.append((k, f"{prose(rng, 8)} phone {number} or +1 {number}. write to mail {rng.choice(WORDS)}@mill.com"))
        rows.append((k + 1, f"{prose(rng, 8)} {prose(rng, 9)} invoice 1234567890123 {prose(rng, 4)}"))
        k += 2
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    phones = sum(any(s["kind"] == "phone" for s in found[d]["added"]) for d in range(0, k, 2))
    assert phones > 250
    assert not any(found[d]["added"] for d in range(1, k, 2))


def test_pii_tries_every_form_of_the_wide_email_pattern():
    for at in ("(at)", "[at]", "{at}", "(AT)", "[AT]", "{AT}", "( at )", "[ AT ]", "{ at }", " (at) ", " at ", " AT "):
        for dot in (".", " dot ", "(dot)", " [DOT] ", "{ dot }"):
            text = f"Reach jane.roe{at}example{dot}com; thanks"
            assert pii.wide_spans(text, []) == [(m.start(), pii.EMAIL, m.end()) for m in pii._WIDE_EMAIL.finditer(text)] != [], text


def test_pii_classifier_goes_by_its_own_features_where_labelers_abstain():
    rng = np.random.default_rng(29)
    n, none = 4000, [pii.NONE] * len(pii.LABELERS)
    true = rng.random(n) < 0.5
    votes = np.where(true[:, None], [1, 1, 2, 1, 1, 1], [0, 0, 0, 2, 1, 0])
    shape, word = np.where(true, 3, 5), np.where(true, rng.integers(1, 4, n), rng.integers(8, 12, n))
    votes = np.concatenate((votes, [none] * 100))
    model = pii.fit(np.full(n + 100, pii.PHONE), votes, np.zeros(n + 100, int), np.concatenate((shape, np.full(100, 6))), np.concatenate((word, np.full(100, 15))), np.ones(n + 100))
    chances = model.chances([pii.PHONE] * 2, [none] * 2, [0, 0], [3, 5], [2, 9])
    assert chances[0] > pii.ACCEPT and chances[1] < 0.2


def test_pii_finds_keys_and_passwords(spark):
    rng = random.Random(30)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'{prose(rng, 9)} token = "{key()}" {prose(rng, 5)} mail a{k}@mill.com') for k in range(60)]
    rows += [(100, "the token: something-that-is-plain-words goes on"), (101, "secret = no"), (102, prose(rng, 30))]
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    for k in range(60):
        text = rows[k][1]
        start = text.index('"') + 1
        assert found[k]["secrets"] == f"secret:{start}:{start + 40}" and found[k]["n_found"] == 2
        assert found[k]["spans"] == pii.joined(base_wanted(text))
    assert [found[k]["n_found"] for k in (100, 101, 102)] == [0, 0, 0]


# op1


LANGUAGES = {"aa": "the stone mill grinds seven times over water".split(), "bb": "zur mühle geht schön kein weg über wasser".split(), "cc": "el molino de piedra más viejo señor agua".split()}


def test_language_id(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(5, 60))), lang) for k, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(600))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 %%", None), (1003, "MÜHLE SCHÖN", None), (None, "water mill", "aa"), (1004, "日本" * 20_000 + "stone mill", None)]
    found = {r["doc_id"]: r for r in lang_id.identify(docs(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert len(found) == len(rows)
    for doc_id, row in found.items():
        assert row["held_out"] == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1
    right = [found[d]["lang_pred"] == lang for d, _, lang in rows[:600] if found[d]["held_out"]]
    assert len(right) > 80 and sum(right) / len(right) > 0.98
    assert [found[d]["lang_pred"] for d in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    kept = {r[0] for r in lang_id.keep_identified(docs(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert kept >= set(range(600)) and not kept & {1000, 1001, 1002}


def test_slices_of_a_long_text_count_as_one(monkeypatch):
    model = lang_id.Model(["x", "y"], np.asfortranarray(np.random.default_rng(0).normal(size=(1 << lang_id.BITS, 2)), np.float32), np.zeros(2))
    texts = ["the mill " * 500, None, "stone", "water " * 90]
    whole = model.scores(texts)
    monkeypatch.setattr(lang_id, "SLICE", 37)
    parts = model.scores(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def naive_bayes(rows, bits):
    """Counts of character n-grams by plain dictionaries; a function of languages' posteriors."""
    counts, n_docs = {}, {}

    def grams(text):
        text = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1)] if text.strip() else []

    for doc_id, text, lang in rows:
        if text is not None and lang is not None and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 5):
            n_docs[lang] = n_docs.get(lang, 0) + 1
            own = counts.setdefault(lang, {})
            for g in grams(text):
                own[g] = own.get(g, 0) + 1

    def posterior(text):
        logs = {x: np.log((n_docs[x] + 1) / (sum(n_docs.values()) + len(n_docs))) + sum(np.log((own.get(g, 0) + 0.5) / (sum(own.values()) + 0.5 * 2**bits)) for g in grams(text)) for x, own in counts.items()}
        top = max(logs.values())
        return {x: np.exp(v - top) / sum(np.exp(w - top) for w in logs.values()) for x, v in logs.items()}

    return posterior


def test_language_id_against_dictionaries(spark, monkeypatch):
    """The same posteriors as plain counts give, with all languages at once or two."""
    rng = random.Random(28)
    words = {**LANGUAGES, "dd": "stone weg agua mill".split(), "ee": "über molino seven".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))), lang) for k, lang in enumerate(rng.choice(list(words)) for _ in range(150))]
    table = docs(spark, rows, "doc_id long, text string, lang string")
    posterior = naive_bayes(rows, 20)
    counts = lang_id.train(table.where(~lang_id.is_held_out("doc_id")), bits=20)
    for at_once in (128, 2):
        monkeypatch.setattr(lang_id, "LANGUAGES_AT_ONCE", at_once)
        for r in lang_id.predict(table, counts).collect():
            wanted = posterior(rows[r["doc_id"]][1])
            assert np.isclose(r["score"], max(wanted.values()), atol=1e-4)
            assert wanted[r["lang_pred"]] >= max(wanted.values()) - 1e-4


def test_language_id_of_six_hundred_languages(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k * 7919 % 1000003:06d}") * 2
    rows = [(k, f"{word(k // 2)} {word(k // 2)}", f"l{k // 2:03d}") for k in range(1200)]
    table = docs(spark, rows, "doc_id long, text string, lang string")
    counts = lang_id.train(table, order=3, bits=12)
    assert len(counts.languages) == 600
    found = {r["doc_id"]: r["lang_pred"] for r in lang_id.predict(table, counts).collect()}
    assert sum(found[d] == lang for d, _, lang in rows) > 1150


# op2


def test_lm_score(spark):
    rng = random.Random(12)
    good, plain = "grind the corn slowly under stone".split(), "click buy cheap offer now winner".split()
    rows = [(k, " ".join(rng.choice(good if k % 2 else plain) for _ in range(60))) for k in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(0, 150)] + [(None, 1, 0), (901, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs(spark, rows), labels).collect()}
    assert all(found[k]["score"] < found[j]["score"] for k in range(151, 300, 2) for j in (150, 200, 298))
    assert found[900]["score"] == found[901]["score"] == 0


def lm_counts(rows, chosen):
    """Counts of words and pairs, the start and end of a text included, by plain
    dictionaries: of all texts, and of those chosen."""
    words, pairs = [{}, {}], [{}, {}]
    for d, text in rows:
        own = (text or "").lower().split()
        for k in (0, 1) if d in chosen else (0,):
            for before, w in zip(["<", *own], [*own, ">"]) if own else ():
                words[k][w] = words[k].get(w, 0) + 1
                pairs[k][before, w] = pairs[k].get((before, w), 0) + 1
    return words, pairs


def lm_chance(words, pairs, vocabulary, scale, before, w):
    total, context = sum(words.values()) * scale, sum(n for (b, _), n in pairs.items() if b == before)
    alone = (words.get(w, 0) * scale + 0.5) / (total + 0.5 * len(vocabulary))
    return 0.6 * (pairs.get((before, w), 0) / context if context else alone) + 0.4 * alone


def test_lm_scores_by_the_counts_of_all_other_documents(spark, monkeypatch):
    """Losses from plain dictionaries, counted anew without each document."""
    rng = random.Random(25)
    rows = [(k, " ".join(f"w{rng.randrange(900)}" if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    rows += [(200, None), (201, "Mill mill"), (202, "alone"), (203, " "), (204, rows[3][1])]
    chosen = {k for k in range(0, 40, 3)}
    labels = spark.createDataFrame([(k, 1, 0) for k in chosen], "doc_id long, quality int, toxic int")
    vocabulary = set(lm_counts(rows, chosen)[0][0])
    wanted = {}
    for d, text in rows:
        own, others = (text or "").lower().split(), [x for x in rows if x[0] != d]
        words, pairs = lm_counts(others, chosen)
        n = [max(1, sum(x for w, x in words[k].items() if w != ">")) for k in (0, 1)]
        sums = [-sum(np.log(lm_chance(words[k], pairs[k], vocabulary, scale, b, w)) for b, w in zip(["<", *own], own)) / max(1, len(own)) for k, scale in ((1, 1.0), (0, n[1] / n[0]))]
        wanted[d] = sums
    for block, part, at_once in ((1 << 30, 1 << 30, 1 << 20), (500, 700, 20)):
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
        monkeypatch.setattr(lm_score, "PART_BYTES", part)
        monkeypatch.setattr(lm_score, "WORDS_AT_ONCE", at_once)
        found = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs(spark, rows), labels).collect()}
        assert len(found) == len(rows)
        for d, (target, corpus) in wanted.items():
            assert np.allclose([found[d]["loss_target"], found[d]["loss_corpus"], found[d]["score"]], [target, corpus, target - corpus]), d
        assert [found[d]["score"] for d in (200, 203)] == [0, 0]


def test_lm_probabilities_sum_to_one():
    rows = [(k, t) for k, t in enumerate(["grind the corn", "the corn and the rye", "corn", "and the corn"])]
    words, pairs = lm_counts(rows, {1, 3})
    vocabulary = sorted(words[0])
    totals = lm_score.Totals((12.0, 8.0), (4.0, 2.0), len(vocabulary) - 1)
    assert totals.words == tuple(sum(x for w, x in words[k].items() if w != ">") for k in (0, 1))
    for before in ["<", *vocabulary]:
        if before != ">":
            array = lambda f: [np.array([f(k, w) for w in vocabulary]) for k in (0, 1)]
            context = array(lambda k, w: sum(n for (b, _), n in pairs[k].items() if b == before))
            found = lm_score.losses(array(lambda k, w: words[k].get(w, 0)), context, array(lambda k, w: pairs[k].get((before, w), 0)), [np.full(len(vocabulary), x) for x in totals.words], [np.full(len(vocabulary), x) for x in totals.texts], totals)
            assert np.allclose([np.exp(-x).sum() for x in found], 1)


def test_lm_numbers_survive_packing():
    for values in ([], [0], [1, 255, 0], [1 << 40, 3], [(1 << 64) - 1, 0]):
        assert lm_score.unpacked(lm_score.packed(np.array(values, np.uint64))).tolist() == values


# op8


def covered_wanted(rows):
    """Sentences in a run of two or more sentences and twenty or more words (least such, to
    either side) that occurs earlier."""
    first, runs = {}, {}
    for doc_id, text in sorted(rows):
        ends, at, sentences = substring_dedup.sentence_ends(text), 0, []
        for end in ends:
            sentences.append(tuple(text[at:end].lower().split()))
            at = end
        found = set()
        for a in range(len(sentences)):
            for b in range(a + 1, len(sentences)):
                if sum(map(len, sentences[a : b + 1])) >= 20:
                    found.add((a, b))
                    break
        for b in range(len(sentences)):
            for a in range(b - 1, -1, -1):
                if sum(map(len, sentences[a : b + 1])) >= 20:
                    found.add((a, b))
                    break
        runs[doc_id] = [(a, b, tuple(sentences[a : b + 1])) for a, b in found]
        for a, _, key in runs[doc_id]:
            first[key] = min(first.get(key, (doc_id, a)), (doc_id, a))
    return {d: {k for a, b, key in rs if first[key] != (d, a) for k in range(a, b + 1)} for d, rs in runs.items()}


def test_substring_dedup(spark):
    rng = random.Random(13)
    shared = [" ".join(prose(rng, rng.randint(3, 18)) for _ in range(6)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randint(1, 20)) for _ in range(rng.randint(0, 8))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((k, ("\n" if k % 2 else " ").join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, ""), (103, "One. Two.")]
    wanted = covered_wanted(rows)
    for r in substring_dedup.remove_repeats(docs(spark, rows)).collect():
        assert r["n_removed"] == len(wanted[r["doc_id"]]), r
    assert sum(map(len, wanted.values())) > 60


def test_substring_dedup_catches_a_passage(spark):
    rng = random.Random(14)
    passage = " ".join(prose(rng, 13) for _ in range(5))
    rows = [(k, f"{prose(rng, 25)} {passage} {prose(rng, 25)}") for k in range(8)]
    found = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert passage in found[0] and not any(passage in found[k] for k in range(1, 8))


def test_substring_dedup_of_long_and_partial_sentences(spark):
    """All words in windows of 51 words seen in an earlier document go: of one sentence,
    without stops, from mid-sentence to mid-sentence, and with lines broken elsewhere."""
    rng = random.Random(24)
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    one, partial, least = some(70), some(90), some(51)
    partial[30], partial[55] = partial[30] + ".", partial[55] + "!"
    rows = [(k, " ".join(some(40) + p + some(40))) for k, p in enumerate([one, partial, least] * 3)]
    rows += [(9, " ".join(some(9) + least[:50] + some(9))), (10, "\n".join(one)), (11, " ".join(["junk"] * 200))]
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    seen = set()
    for doc_id, text in rows:
        words = text.lower().split()
        keys = [tuple(words[k : k + 51]) for k in range(len(words) - 50)]
        gone = {k + j for k, key in enumerate(keys) if key in seen for j in range(51)}
        seen.update(keys)
        if doc_id != 11:
            assert found[doc_id]["text"].lower().split() == [w for k, w in enumerate(words) if k not in gone], doc_id
            assert found[doc_id]["n_words_removed"] == len(gone)
    assert [found[k]["n_words_removed"] for k in (0, 3, 4, 5, 9, 10)] == [0, 70, 90, 51, 0, 70]
    assert found[11]["text"].split() == ["junk"] * 51


def test_places_of_runs():
    first, last = np.array([0, 5, 9, 7, 3]), np.array([3, 131, 136, 9000, 53])
    known, check = np.array([0, 0, 0, 0, 1]), np.array([1, (1 << 24) - 1, 77, 5, 9])
    places = substring_dedup._place(first, last, known, check)
    assert (places >= 0).all()
    assert [substring_dedup.span_of(int(x)) for x in places] == list(zip(first.tolist(), last.tolist()))


def test_equal_runs_have_equal_hashes_wherever_they_stand():
    rng = random.Random(31)
    shared = " ".join(prose(rng, 12) for _ in range(3))
    found = [dict(zip(zip(*map(list, x[:2])), zip(x[2].tolist(), x[3].tolist()))) for x in map(substring_dedup.runs, (shared, f"{prose(rng, 30)} {shared}"))]
    assert found[0][0, 1] == found[1][1, 2] and found[0][1, 2] == found[1][2, 3]
    assert len({x[1] for x in found[1].values()}) == len(found[1])


# op10


def test_mixing_meets_its_targets(spark):
    rng = random.Random(15)
    vocab = {0: "grind corn stone wheel".split(), 1: "misc thing item stuff".split(), 2: "vile awful nasty rude".split()}
    rows, labels = [], []
    for k in range(600):
        kind = rng.choices((0, 1, 2), (6, 3, 1))[0]
        rows.append((k, " ".join(rng.choice(vocab[kind]) for _ in range(rng.randint(20, 80)))))
        if k % 2:
            labels.append((k, int(kind != 1), int(kind == 2)))
    table, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = mixing.mix(table, known).toPandas()
    words = found.n_tokens.sum()
    for k, name in enumerate(mixing.DOMAINS):
        share = (found.n_tokens * found.rate * found[f"p_{name}"]).sum() / words
        assert abs(share - mixing.TARGETS[name]) < 1e-3, (k, name, share)
    assert (found.rate >= 0).all() and (found.copies >= np.floor(found.rate)).all() and (found.copies <= np.ceil(found.rate)).all()
    kept = mixing.mixed(table, known).groupBy("doc_id").count().toPandas()
    toxic = {k for k, t in rows if t.split()[0] in vocab[2]}
    assert set(kept.doc_id) >= {k for k, _ in rows} - toxic
    assert len(set(kept.doc_id) & toxic) < len(toxic)


@pytest.mark.parametrize("seed,shares", [(16, (0.5, 0.4, 0.1)), (17, (0.9, 0.0999, 0.0001)), (18, (0.1, 0.1, 0.8)), (20, (0.3, 0.7, 0.0))])
def test_fit_against_a_plain_projected_gradient(spark, seed, shares):
    """Totals as near to the targets as a plain projected gradient on all rates comes after
    very many steps; also of a domain with one word in ten thousand, and of none."""
    rng = np.random.default_rng(seed)
    n = 400
    sure = rng.choice(3, n, p=shares)
    words = rng.integers(0, 200, n)
    if shares[2] == 0.0001:
        sure[sure == 2] = 0
        sure[7], words[7] = 2, words.sum() // 10_000
    p = rng.dirichlet((0.2, 0.2, 0.2), n) * np.array(shares) * 0.1 + 0.9 * np.eye(3)[sure]
    p /= p.sum(axis=1, keepdims=True)
    members = spark.createDataFrame([(int(w), x.tolist()) for w, x in zip(words, p)], "n_tokens long, p array<double>").coalesce(2).cache()
    targets = np.array([0.80, 0.18, 0.02])
    fit = mixing.fit_rates(members, targets)
    found = mixing.rates(p, words, fit.steps)
    assert (found >= 0).all() and (found[words == 0] == 1).all()
    a = (words[:, None] * p).T / words.sum()
    assert np.allclose(a @ found, fit.totals / words.sum())
    plain, step = np.ones(n), 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(50_000):
        plain = np.maximum(0, plain - step * (a.T @ (a @ plain - targets)))
    assert np.linalg.norm(a @ found - targets) <= np.linalg.norm(a @ plain - targets) + 1e-3
    assert fit.unmet() == [x for x, miss in zip(mixing.DOMAINS, np.abs(a @ found - targets)) if miss > mixing.MISS] == (["toxic"] if shares[2] == 0 else [])


# op4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div class="post-17 body-text"><h1>Head &amp; tail</h1><p><b>First   line<br><p>Second &lt;line&gt; with <a href=x>a link</a>.</p><form>Mail <input></form><div id="comments"><p>Nice!</p></div></div>
<aside>Side</aside><footer>&copy; us</footer>"""


def test_html(spark):
    rows = [(k, f"http://host{k % 2}.example.com/{k}", PAGE.replace("17", str(k))) for k in range(6)] + [(10, None, PAGE), (11, "http://x.org", None), (12, "http://x.org", ""), (13, "no url", "plain text only"), (14, "http://host0.example.com/9", "<p>Other template with text.")]
    found = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wanted = "Head & tail\nFirst line\nSecond <line> with a link."
    assert all(found[k]["text"] == wanted for k in (*range(6), 10))
    assert [found[k]["text"] for k in (11, 12, 13, 14)] == ["", "", "plain text only", "Other template with text."]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_html_votes_by_host(spark):
    pages = spark.createDataFrame([(k, "http://h.example.com/", PAGE.replace("17", str(k))) for k in range(3)], "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.winning_paths(pages).collect()] == [("h.example.com", "body.has-sidebar>div.body-text.post-#")]


def test_html_by_shuffle_is_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k}.example.com/", PAGE) for k in range(9)], "page_id long, url string, html string")
    few = sorted(map(tuple, html_extract.main_text(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html_extract.main_text(pages).collect())) == few


def test_html_keeps_running_text_beside_the_best_container(spark):
    story, more = " ".join(["story"] * 100), " ".join(["more"] * 100)
    rows = [(k, "http://h.example.com/", f"<body><div class=story><p>{story}</p></div>") for k in range(5)]
    rows += [(5, "http://h.example.com/", f"<body><div class=story><p>{story}</p></div><div class=rest><p>{more}</p></div>")]
    rows += [(6, "http://x.example.com/", f"<body><div><p>A lead.</p><div><p>{story}</p><p>{more}</p></div><p>The end.</p></div><p><a href=/>Home</a></p>")]
    found = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == story for k in range(5))
    assert found[5] == f"{story}\n{more}"
    assert found[6] == f"A lead.\n{story}\n{more}\nThe end."


def test_html_names_are_evidence(spark):
    """Classes with a furniture word among others lose their text only if it reads like
    furniture."""
    kept = html_extract.Page('<body><div class="article-comment-policy"><p>Real text of the page.</p></div><p>Other para.</p>')
    assert kept.text(None) == "Real text of the page.\nOther para."
    menu = html_extract.Page('<body><p>All of the text.</p><div class="acme-nav-x"><a href=/>Home</a> <a href=/b>Blog</a></div><div id="acme-share"><span>Tweet</span></div><div class="comment-list"><p>I like it. Really.</p></div>')
    assert menu.text(None) == "All of the text."


def test_html_of_several_templates(spark):
    one = '<body><header><a href=/>Site</a></header><div id=main-column class="col-8"><h2>{t}</h2><p>{p}</p><ul><li>First<li>Second</ul></div><div class="sidebar col-4"><p>Read this as well. And that.</p></div><footer>x</footer>'
    two = '<table><tr><td class=menu><a href=a>A</a><td class=story>{t}<br>{p}<tr><td colspan=2>Imprint <a href=i>here</a></table>'
    three = '<body><main><article><header><h1>{t}</h1></header><section><p>{p}</p></section><section class=comments><p>Nice one!</p></section></article></main><div role=dialog>Cookies?</div>'
    texts = ["Mills grind slowly. They always have.", "Stones turn. Water falls &mdash; and rises.", "Bread &amp; light."]
    rows, wanted = [], {}
    for k in range(30):
        page, p = (one, two, three)[k % 3], texts[k % 7 % 3]
        plain = p.replace("&mdash;", "\u2014").replace("&amp;", "&")
        rows.append((k, f"https://www.h{k % 3}.org/p/{k}", page.format(t=f"Title {k}", p=p)))
        wanted[k] = (f"Title {k}\n{plain}\nFirst\nSecond", f"Title {k} {plain}\nImprint here", f"Title {k}\n{plain}")[k % 3]
    found = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == wanted


def test_html_of_deep_pages_takes_linear_time_and_memory():
    for source in ("<div>" * 200_000 + "deep", "<b>" * 50_000 + "<li>x</li>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x", "<div class=a>" * 50_000 + "<p>x" + "</p>" * 50_000):
        page = html_extract.Page(source)
        assert len(page.scores()) == len(page.containers)
        assert page.text("body>div") != ""
        assert sum(len(page.path(k)) for k in range(len(page.containers))) < 200 * len(source)


def test_html_where_names_mark_the_whole_page():
    page = html_extract.Page('<body><div class="page with-sidebar"><p>All of the text.</p><nav>Menu</nav></div>')
    assert page.text(None) == "All of the text."


def test_mixing_without_a_domain(spark):
    rows = [(k, " ".join(["grind corn stone", "misc thing item"][k % 2].split() * 20)) for k in range(100)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    found = mixing.mix(docs(spark, rows), labels).toPandas()
    assert found.rate.max() < 3 and found.rate.min() > 0
    kept = mixing.mixed(docs(spark, rows), labels)
    assert {r[0] for r in kept.select("doc_id").distinct().collect()} == set(range(100))
