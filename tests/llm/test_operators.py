"""Every operator against brute force on a whole small table, and on edge rows."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
from cases import EDGE_TEXTS, SCHEMA, documents, edge, empty, folder, rows_of, texts  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from fieldline.llm import decontaminate, langid, lmscore, mixing, pii, quality, repeats, secrets, simhash, tokens
from fieldline.llm.components import components
from fieldline.llm.ordering import running_total
from fieldline.session import materialise, new_path

EDGE_IDS = [e[0] for e in EDGE_TEXTS]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# SimHash


def test_fingerprint_is_the_majority_of_shingle_hashes(texts):
    for _, text in texts + [(0, e[1]) for e in EDGE_TEXTS]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute.fingerprint(text)


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_near_duplicates_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    prints = [brute.fingerprint(r.text) for r in rows]
    want = zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], brute.components([r.doc_id for r in rows], prints))
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_links_are_whole_for_crowded_signatures(spark):
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    near = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for _ in range(150)} | {draw.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in near]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = dict(zip(signed, brute.components(signed, [p % (1 << 64) for p in signed])))
    for paired in (0, 16, 10_000):
        roots = {r.node: r.root for r in components(simhash.links(frame, paired=paired)).collect()}
        assert {p: roots.get(p, p) for p in signed} == want


def test_keep_one_row_of_each_component(spark, documents, edge, empty):
    rows = documents.select("doc_id", "text").collect()
    roots = brute.components([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))
    left = simhash.keep_one(edge)
    assert left.columns == edge.columns and len([r for r in left.collect() if r.doc_id == 5]) == 1
    assert simhash.keep_one(empty).count() == simhash.near_duplicates(empty).count() == 0


def broadcast_keys(df):
    """First keys of the joins by broadcast that Spark plans."""
    return re.findall(r"Broadcast(?:HashJoin \[(\w+)|NestedLoopJoin)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def plans(monkeypatch):
    """``broadcast_keys`` of all tables that SimHash and its components store, by name.

    The smallest ids meet the components by root: Spark takes that table for the product of two, and broadcasts it only
    where this is little.
    """
    found = {}

    def told(df, name="table"):
        found.setdefault(name, []).extend(k for k in broadcast_keys(df) if (name, k) != ("simhash-components", "root"))
        return materialise(df, name)

    monkeypatch.setattr(simhash, "materialise", told)
    monkeypatch.setattr(sys.modules[components.__module__], "materialise", told)
    monkeypatch.setattr(sys.modules[components.__module__], "BROADCAST_EDGES", 0)
    return found


@pytest.fixture
def near_copies(spark):
    """Texts of which some differ in a word, in a table that Spark takes for small."""
    draw = random.Random(5)
    base = [[f"w{draw.randrange(500)}" for _ in range(300)] for _ in range(12)]
    texts = [" ".join([*words[:-1], f"end{k % 3}"]) for words in base for k in range(5)]
    return spark.createDataFrame(rows_of([(i, t, "en", "a") for i, t in enumerate(texts)]), SCHEMA)


def test_signatures_are_not_broadcast(spark, plans, near_copies):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10485760b")
    out = simhash.near_duplicates(near_copies)
    assert out.select("component_id").distinct().count() < out.count() == 60
    assert {"simhash-shared", "simhash-links", "components", "simhash-components"} <= set(plans)
    assert not any(plans.values()) and not broadcast_keys(out)


def test_kept_rows_and_places_are_not_broadcast(plans, near_copies):
    kept = simhash.keep_one(near_copies)
    assert 0 < kept.count() < 60
    assert not any(plans.values()) and not broadcast_keys(kept)
    assert not broadcast_keys(mixing.mixed(near_copies))


def test_components_of_random_graphs(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((x, find(x)) for x in {y for e in edges if e[0] != e[1] for y in e})
    assert collected(components(spark.createDataFrame(edges, "a long, b long")), "node", "root") == sorted(want, key=repr)


# Personal data


def test_pseudonyms_keep_format_and_links(spark):
    lines = [
        "write to jan.34@mail7.example.com now",
        "card 4111 1111 1111 1111, again 4111111111111111, not 4111111111111112",
        "host 10.0.0.255 not 999.1.1.1",
        "born 2024-02-29, not 2023-02-29; 31.12.1999",
        "+1 (487) 555-7209",
        "ssn 123-45-6789 not 000-12-1234",
        "DE89 3704 0044 0532 0130 00 not DE89 3704 0044 0532 0130 01",
    ]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines * 2)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, key="k").collect()}
    for i, line in enumerate(lines):
        new = got[i].text
        assert new == got[i + len(lines)].text != line  # equal values stay linked
        digits = "[0-9]+" if "host" in line else "[0-9]"  # numbers of an address have one to three digits
        assert re.sub(digits, "9", re.sub("[a-z]", "a", new)) == re.sub(digits, "9", re.sub("[a-z]", "a", line))
    cards = re.findall(r"[0-9](?:[ ]?[0-9]){15}", got[1].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and cards[2] == "4111111111111112"
    doubled = [int(c) * (2 - k % 2) for k, c in enumerate(cards[1])]
    assert sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    iban = got[6].text.split(" not ")[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "999.1.1.1" in got[2].text and "2023-02-29" in got[3].text and "000-12-1234" in got[5].text
    assert [got[i].pii[f"n_{k}"] for i, k in ((0, "email"), (1, "card"), (2, "ip"), (3, "date"), (4, "phone"), (5, "ssn"), (6, "iban"))] == [1, 2, 1, 2, 1, 1, 1]
    other = {r.doc_id: r.text for r in pii.pseudonymise(docs, key="another").collect()}
    assert all(other[i] != got[i].text for i in range(len(lines)))


def test_neighbours_do_not_hide_values(spark):
    cases = [
        ("BE68 5390 0754 7034", " EUR"), ("AT61 1904 3002 3457 3201", " 12 A"), ("ES91 2100 0418 4502 0005 1332", " IBAN"),
        ("PL61 1090 1014 0000 0712 1981 2874", " PLN"), ("DE89370400440532013000", " EUR"), ("NO93 8601 1117 947", " NOK"),
        ("2024-01-31", "T10:00"), ("2024-01-31", "T10:00:00.5Z"), ("2024-01-31", "t1000"), ("2024-01-31", "T10Z"),
    ]
    docs = spark.createDataFrame([(k, f"to {a}{b}.", a, f"to {a}") for k, (a, b) in enumerate(cases)], "doc_id long, text string, value string, bare string")
    for r in pii.pseudonymise(pii.pseudonymise(docs, key="k"), text="bare", key="k", counts="alone").collect():
        value, tail = cases[r.doc_id]
        assert value not in r.text and r.text == f"{r.bare}{tail}." and sum(r.pii) == sum(r.alone) == 1
    plain = spark.createDataFrame([("2023-02-29T10:00 2024-01-31Tea 2024-01-31x BE68 5390 0754 7035 EUR",)], "text string")
    assert pii.pseudonymise(plain).first().text == plain.first().text


def replaced(spark, values, key="k"):
    """The pseudonym of each value, which stands alone in its text."""
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(8)
    return [r.text for r in sorted(pii.pseudonymise(docs, key=key).collect(), key=lambda r: r.doc_id)]


def test_dates_map_one_to_one_within_their_form(spark):
    """All dates of 80 years, month first and day first, padded and not."""
    first, days = date(1950, 1, 1), (date(2030, 1, 1) - date(1950, 1, 1)).days
    every = [first + timedelta(k) for k in range(days)]
    forms = ["{m:02d}/{d:02d}/{y}", "{d:02d}/{m:02d}/{y}", "{m}/{d}/{y}", "{d}.{m}.{y}", "{y}-{m:02d}-{d:02d}"]
    values = sorted({f.format(y=x.year, m=x.month, d=x.day) for f in forms for x in every})
    got = replaced(spark, values)
    assert len(set(got)) == len(values)
    shape = lambda v: re.sub("[0-9]", "9", v)
    for old, new in zip(values, got):
        before, after = brute.date_fields(old), brute.date_fields(new)
        assert after and shape(old) == shape(new) and before[:2] == after[:2] and 1900 <= after[2] <= 2049
    assert sum(a == b for a, b in zip(values, got)) < 20
    for k in draw_from(values, 300, 5):
        assert got[k] == brute.date_pseudonym(values[k], "k")


def draw_from(values, many, seed):
    return random.Random(seed).sample(range(len(values)), many)


def test_dates_of_other_centuries_stay_there(spark):
    values = ["0001-01-01", "0099-12-31", "1582-10-10", "1899-12-31", "2050-01-01", "9999-12-31", "29.2.2000", "02/29/2096", "31/12/0007"]
    for old, new in zip(values, replaced(spark, values)):
        assert new == brute.date_pseudonym(old, "k")
        assert (brute.date_fields(old)[2] - 1900) // 150 == (brute.date_fields(new)[2] - 1900) // 150


PRIVATE = [
    "Mail anna.b+c@mail7.example.com, Öz_1@x.org or a@b; card 4111 1111 1111 1111, 9807915762804490 and 5500-0000-0000-0004!",
    "call +1 (017) 555-7713 or 017.555.7713, +49 30 1234567, 555 123; ip 97.51.17.173 and 300.1.1.1, ssn 123-45-6789 000-12-3456 667-01-0001",
    "IBAN DE89 3704 0044 0532 0130 00, BE68539007547034 EUR, GB82WEST12345698765432, DE00 3704 0044 0532 0130 00. 2024-01-31T10:00 5.3.1984 25/01/1950 13/13/2000",
]


def test_pseudonyms_equal_brute_force(spark, documents):
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(PRIVATE, 10_000)), "doc_id long, text string"))
    full = lambda pattern: lambda value, p=regex.compile(pattern): p.fullmatch(value) is not None
    checks = [full(p) for p in (pii.IBAN, f"{pii.ISO_DATE}|{pii.DAY_DATE}|{pii.SLASH_DATE}", pii.SSN, pii.IP, pii.CARD, pii.PHONE)]
    every, total = regex.compile(pii.ANY), Counter()
    for r in docs.join(pii.pseudonymise(docs, key="k").withColumnRenamed("text", "new"), "doc_id").collect():
        found = Counter()

        def change(m):
            kind, new = brute.pseudonym(m[0], "k", *checks)
            found[kind] += 1
            return new

        assert r.new == every.sub(change, r.text)
        assert all(r.pii[f"n_{k}"] == found[k] for k in pii.KINDS)
        total += found
    assert all(total[k] >= 1 for k in pii.KINDS)


def test_feistel_is_a_permutation(spark):
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    found = {r[0] for r in three.select(pii.permuted_digits(F.col("d"), "k", "t")).collect()}
    assert found == {f"{k:03d}" for k in range(1000)}
    pairs = spark.range(5 * 7).select(pii.feistel((F.col("id") / 7).cast("long"), F.col("id") % 7, F.lit(5), F.lit(7), "k", "t").alias("p"))
    assert {(r.p.l, r.p.r) for r in pairs.collect()} == {(a, b) for a in range(5) for b in range(7)}


def test_pseudonyms_of_edge_rows_and_plain_texts(documents, edge, empty):
    assert collected(pii.pseudonymise(edge), "doc_id", "text") == collected(edge, "doc_id", "text")
    assert pii.pseudonymise(empty).columns == [*empty.columns, "_pii"] and pii.pseudonymise(empty).count() == 0
    assert {r["pii"] for r in pii.pseudonymise(edge).collect()} == {"p"}  # a column of that name is kept
    assert simhash.with_fingerprint(edge, into="fp").columns == [*edge.columns, "_fp"]
    pairs = documents.join(pii.pseudonymise(documents).select("doc_id", F.col("text").alias("new"), "pii"), "doc_id").collect()
    for r in pairs:
        assert (r.text == r.new) == (sum(r.pii) == 0)
        for value in re.findall(r"[\w.]+@[\w.]+|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", r.text):
            assert value not in r.new


# Decontamination


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_matches_equal_brute_force(spark, folder, documents, texts, block_words):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "the"), (900, None), (None, "Of, and the"), (901, ""), (902, "of and THE")], "item_id long, text string")
    items = benchmark.select("item_id", "text").unionByName(extra)
    pairs = [("null" if r.item_id is None else r.item_id, r.text) for r in items.collect()]
    found = decontaminate.matches(documents, items, block_words=block_words)
    got = {r.doc_id: (r.n_words, r.n_hit, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), len(r.item_ids)) for r in found.collect()}
    assert got == dict(zip([i for i, _ in texts], brute.contamination([t for _, t in texts], pairs)))


def test_longest_match_and_spans(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"W{k}" for k in range(5, 25)) + " z"), (2, " ".join(f"w{k}" for k in range(9)))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].longest == 20 and [tuple(s) for s in got[1].spans] == [(2, 20)]
    assert got[2].longest == 0 and got[2].n_hit == 0


def test_contamination_of_edge_rows(spark, edge, empty):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "word " * 10)], "item_id long, text string")
    got = Counter((r.doc_id, r.n_hit > 0) for r in decontaminate.matches(edge, items).collect())
    assert got == Counter((e[0], e[0] in (5, 6, 8)) for e in EDGE_TEXTS)
    clean = decontaminate.remove_contaminated(edge, items)
    assert clean.columns == edge.columns and Counter(r.doc_id for r in clean.collect()) == Counter(i for i in EDGE_IDS if i not in (5, 6, 8))
    assert decontaminate.remove_contaminated(edge, items.limit(0)).count() == len(EDGE_IDS)
    assert decontaminate.matches(empty, items).count() == decontaminate.remove_contaminated(empty, items).count() == 0


# Token files


def test_tokens_round_trip(spark, documents, texts):
    path = new_path(spark, "tokens")
    tokens.write(documents.repartition(5), path, WORD_BPE)
    plain = Tokenizer.from_file(WORD_BPE)
    assert collected(tokens.checksums(tokens.read(spark, path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.token_rows(texts, plain), key=repr)


def test_words_are_encoded_as_whole_texts_are(texts):
    plain, own = Tokenizer.from_file(WORD_BPE), tokens.Encoder(WORD_BPE)
    odd = "İstanbul ẞ ÀÉÎ naïve, it's don't. 'S 12a b3 x_y a　b é, ﬁ ΣΑΣ. A.B. ., ,a \x1c\x1dz ÿÿ, ðþ. µ ª º ×÷ a×b ñ́ 😀x ß,. é"
    whole = [t for _, t in texts] + [odd] + [e[1] or "" for e in EDGE_TEXTS]
    ids, lengths = own.encode([t.encode() for t in whole], end_id=None)
    ends = np.cumsum(lengths)
    for text, a, b in zip(whole, ends - lengths, ends):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_literals_of_added_tokens_are_one_id(spark):
    plain = Tokenizer.from_file(WORD_BPE)
    whole = ["foo <|endoftext|> bar", "A<|startoftext|>B's <|endoftext|><|endoftext|>, É", "foo <|ENDOFTEXT|> bar", "<|endof text|>", "end <|endoftext|>!! of"]
    assert plain.encode(whole[0], add_special_tokens=False).ids == [23435, 49407, 2411]
    path = new_path(spark, "tokens")
    tokens.write(spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string"), path, WORD_BPE)
    assert collected(tokens.checksums(tokens.read(spark, path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.token_rows(enumerate(whole), plain), key=repr)


def test_token_files_have_the_promised_layout(spark, documents, edge, empty):
    path = new_path(spark, "tokens")
    tokens.write(documents, path, WORD_BPE)
    files = [f"{path.removeprefix('file:')}/{f}" for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["doc_id"].has_column_index and columns["tokens"].has_offset_index
    path = new_path(spark, "tokens")
    tokens.write(edge, path, WORD_BPE)
    rows = tokens.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(EDGE_IDS, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    path = new_path(spark, "tokens")
    tokens.write(empty, path, WORD_BPE)
    assert tokens.read(spark, path).count() == 0


def test_tokens_in_stored_order(spark, documents, edge, empty):
    plain = Tokenizer.from_file(WORD_BPE)
    turned = documents.repartitionByRange(7, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    path = new_path(spark, "turned")
    turned.write.parquet(path)
    docs = [(r.doc_id, r.text) for r in sorted(documents.collect(), key=lambda r: -r.doc_id)]
    want = sorted(brute.token_rows(docs, plain, as_given=True), key=repr)
    for split in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        for given in (spark.read.parquet(path), spark.createDataFrame(docs, "doc_id long, text string")):  # stored, or not yet
            out = new_path(spark, "tokens")
            tokens.write(given, out, WORD_BPE, as_stored=True)
            assert collected(tokens.checksums(tokens.read(spark, out)), "doc_id", "start", "n_tokens", "ids_crc32") == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tokens.write(spark.read.parquet(path).repartition(3), out := new_path(spark, "tokens"), WORD_BPE, as_stored=True)
    with pytest.raises(Exception, match="dealt out anew"):
        tokens.read(spark, out).collect()
    for given, many in ((edge, len(EDGE_TEXTS)), (empty, 0)):
        out = new_path(spark, "tokens")
        tokens.write(given, out, WORD_BPE, as_stored=True)
        assert tokens.read(spark, out).count() == many


# Quality rules


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_quality_counts_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    got = quality.with_counts(docs.select("doc_id", "text"), into="c").collect()
    for r in got:
        want = brute.quality_counts(r.text)
        assert {k: r.c[k] for k in want} == want


def test_verdicts_equal_a_plain_em(documents):
    counted = quality.with_counts(documents).select("doc_id", "counts")
    rules = quality.rules(F.col("counts"))
    rows = counted.select("doc_id", "counts", F.struct(*[v.alias(n) for n, v in rules.items()]).alias("votes")).collect()
    odds = brute.em([r.votes.asDict() for r in rows], quality.believed)
    want = {r.doc_id: (brute.base_failed(r.counts), not brute.base_failed(r.counts) and odds(r.votes) >= 0) for r in rows}
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality.scores(documents).collect()} == want


def test_rules_agree_with_labels(spark, folder, documents):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.scores(documents).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9


def test_quality_of_edge_rows(edge, empty):
    got = quality.scores(edge)
    assert Counter(r.doc_id for r in got.collect()) == Counter(EDGE_IDS)
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got.filter("kept").collect())
    assert quality.scores(empty).count() == quality.keep_good(empty).count() == 0


# Language-model scores


def plain_vocabulary(texts):
    """Rank of the most frequent words, and the log share of its band of every other word."""
    counts = Counter(w for t in texts for w in (t or "").encode().lower().split())
    order = sorted(counts, key=lambda w: (-counts[w], lmscore.hashes_of([w])[0]))
    rank = {w: k for k, w in enumerate(order[: lmscore.OWN])}
    rest = Counter()
    for w in order[lmscore.OWN :]:
        rest[min(counts[w].bit_length() - 1, lmscore.BANDS - 1)] += counts[w]
    share = {}
    for w in order[lmscore.OWN :]:
        band = min(counts[w].bit_length() - 1, lmscore.BANDS - 1)
        share[w] = (band, np.log(counts[w] / rest[band]))
    return rank, share


def plain_score(text, rank, share, flat, words):
    """Log-probability of a text, a word at a time."""
    p = {k: v.astype(float) for k, v in lmscore._parts(flat).items()}
    tokens = (text or "").encode().lower().split()
    code = [rank[w] if w in rank else lmscore.OWN + share[w][0] for w in tokens]
    total = 0.0
    for i, w in enumerate(tokens):
        h = p["hidden"].copy()
        for j, k in enumerate(lmscore.OFFSETS):
            h += p["embed"][j][code[i + k] + 1 if 0 <= i + k < len(code) else 0]
        h = np.tanh(h)
        logits = h @ p["out"] + p["bias"]
        c = words["class_of"][code[i]] if w in rank else lmscore.CLASSES + share[w][0]
        total += logits[c] - np.log(np.exp(logits).sum())
        if w in rank:
            members = slice(words["starts"][c], words["starts"][c + 1])
            own = p["own"][members] @ h + p["own_bias"][members]
            total += own[code[i] - members.start] - np.log(np.exp(own).sum())
        else:
            total += share[w][1]
    return total


def test_scores_equal_a_word_at_a_time(spark, documents, edge):
    rows = documents.select("doc_id", "text").union(edge.select("doc_id", "text"))
    encoded, words = lmscore.prepared(rows.repartition(3))
    texts = [r.text for r in rows.collect()]
    rank, share = plain_vocabulary(texts)
    assert [lmscore.hashes_of([w])[0] for w in sorted(rank, key=rank.get)] == words["hashes"].tolist()
    sizes = np.diff(words["starts"])
    assert len(sizes) <= lmscore.CLASSES and sizes.sum() == len(rank) and (words["class_of"] == np.repeat(np.arange(len(sizes)), sizes)).all()
    flat = lmscore.initial(4) * 5
    got = []
    for row in encoded.collect():
        row = row.asDict()
        codes, shares = lmscore._codes(row), np.frombuffer(row["shares"], "<f4").astype(float)[lmscore._unpacked(row["words"])]
        lengths = np.array(row["lengths"])
        got += zip(row["doc_ids"], lengths.tolist(), lmscore.score_texts(codes, shares, lengths, flat, words))
    short = [t for t in texts if len(t or "") < 3_000]
    want = sorted((len((t or "").encode().split()), plain_score(t, rank, share, flat, words)) for t in short)
    assert len(got) == len(texts)
    small = sorted((n, x) for i, n, x in got if any(n == w for w, _ in want))
    for n, x in want:
        assert any(m == n and abs(x - y) < 1e-3 * max(1, n) for m, y in small)


def test_probabilities_add_up_to_one(spark, documents):
    encoded, words = lmscore.prepared(documents.limit(50))
    p = lmscore._parts(lmscore.initial(2) * 20)
    near = np.random.default_rng(0).integers(0, lmscore.INPUTS, (len(lmscore.OFFSETS), 1)).astype(np.uint16)
    known = len(words["hashes"])
    own = [np.exp(lmscore._log_probabilities(p, near, np.array([c]), words)[0]) for c in range(known)]
    bands = [np.exp(lmscore._log_probabilities(p, near, np.array([lmscore.OWN + k]), words)[0]) for k in range(lmscore.BANDS)]
    hidden = lmscore._hidden(p, near) @ p["out"] + p["bias"]
    empty_classes = range(len(words["starts"]) - 1, lmscore.CLASSES)  # of a small vocabulary
    empty = [np.exp(lmscore._log_softmax_at(hidden.copy(), np.array([c]))[0]) for c in empty_classes]
    assert sum(own) + sum(bands) + sum(empty) == pytest.approx(1, abs=1e-3)


def test_gradient_equals_finite_differences(spark, documents):
    _, words = lmscore.prepared(documents.limit(80))
    draw = np.random.default_rng(3)
    codes = np.where(draw.random(40) < 0.8, draw.integers(0, len(words["hashes"]), 40), lmscore.OWN + draw.integers(0, 5, 40))
    near = lmscore.neighbours(codes, np.array([15, 0, 25]))
    flat = (lmscore.initial(6) * 3).astype(np.float64)
    grad = np.zeros(lmscore.SIZE)
    lmscore.gradient(lmscore._parts(flat), lmscore._parts(grad), near, codes, words)

    def loss(at, step):
        moved = flat.copy()
        moved[at] += step
        return -lmscore._log_probabilities(lmscore._parts(moved), near, codes, words).mean()

    used = np.flatnonzero(grad)
    for at in draw.choice(used, 60, replace=False):
        assert (loss(at, 1e-5) - loss(at, -1e-5)) / 2e-5 == pytest.approx(grad[at], rel=1e-3, abs=1e-8)


def test_training_on_spark_equals_training_in_place(spark, documents, edge, empty):
    encoded, words = lmscore.prepared(documents.coalesce(1))
    flat = lmscore.fit(encoded, words)
    want = lmscore.initial()
    rows = [r.asDict() for r in encoded.collect()]
    for turn in range(lmscore.ROUNDS):
        total = lmscore.train_on((lmscore._texts_of_turn(lmscore._codes(r), np.array(r["lengths"]), turn) for r in rows), want, words)
        want = (total[:-1] / total[-1]).astype(np.float32)
    assert np.allclose(flat, want, atol=1e-3)
    many, few = (lmscore._averaged(encoded.repartition(n), 0, want, words) for n in (100, 3))  # added up in two steps, and in one
    assert np.isfinite(many).all() and np.allclose(many, few, atol=1e-3)
    got = {r.doc_id: r for r in lmscore.scores(documents).collect()}
    assert all(r.log_prob < 0 and r.mean_log_prob == pytest.approx(r.log_prob / r.n_tokens) for r in got.values() if r.n_tokens)
    trained, start, better, long = 0.0, 0.0, 0, 0
    draw = np.random.default_rng(5)
    for row in rows:
        codes, shares, lengths = lmscore._codes(row), np.frombuffer(row["shares"], "<f4").astype(float)[lmscore._unpacked(row["words"])], np.array(row["lengths"])
        trained += lmscore.score_texts(codes, shares, lengths, flat, words).sum()
        start += lmscore.score_texts(codes, shares, lengths, lmscore.initial(), words).sum()
        ends = np.cumsum(lengths)
        for b, n in zip(ends, lengths):
            if n >= 50:
                turn = draw.permutation(n)
                pair = [lmscore.score_texts(codes[b - n : b][o], shares[b - n : b][o], np.array([n]), flat, words)[0] for o in (np.arange(n), turn)]
                better, long = better + (pair[0] > pair[1]), long + 1
    assert trained > start and better > 0.6 * long
    assert Counter(r.doc_id for r in lmscore.scores(edge).collect()) == Counter(EDGE_IDS)
    none = [r for r in lmscore.scores(edge.filter("doc_id < 4")).collect()]
    assert {(r.n_tokens, r.log_prob, r.mean_log_prob) for r in none} == {(0, 0.0, None)} and len(none) == 3
    assert lmscore.scores(empty).count() == 0


# Repeated passages


@pytest.mark.parametrize("name", ["documents", "edge"])
def test_repeats_equal_brute_force(request, name):
    docs = request.getfixturevalue(name).select("doc_id", "text")
    rows = docs.collect()
    want = zip([r.doc_id for r in rows], brute.repeats([r.text for r in rows]))
    got = [(r.doc_id, (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in repeats.remove_repeats(docs.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeats_of_planted_lengths(spark, empty):
    draw = random.Random(11)
    noise = lambda n: "".join(draw.choice("abcdefghij \n") for _ in range(n))
    rows = []
    for k, n in enumerate((399, 400, 401, 450, 600, 1000)):
        passage = noise(n)
        rows += [(2 * k, noise(draw.randrange(900)) + passage + noise(draw.randrange(900))), (2 * k + 1, noise(draw.randrange(900)) + passage + noise(draw.randrange(900)))]
    rows += [(50, "ab" * 500), (51, noise(1000) + "ab" * 300), (52, noise(300) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(zip([r[0] for r in rows], brute.repeats([r[1] for r in rows])))
    assert repeats.remove_repeats(empty).count() == 0


# Secrets


def test_base_findings_equal_the_patterns(texts):
    extra = ["TOKEN: abcdef", "paſſword=abcdefg", "apikey='x' api_key = abcdefgh", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "a" * 23 + " " + "0" * 24 + "g", "secret=secret=abcdef", "password=abc password: abcdef"]
    for text in [t for _, t in texts] + extra + [e[1] for e in EDGE_TEXTS]:
        assert secrets.base_findings(text or "") == brute.base_secrets(text)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def leaks():
    """(id, text) with labelled secrets, plain candidates, and secrets that no base pattern covers; the kinds of the latter by id."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9)))
    key = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    rows = [(k, f'{word()} {word()} token = "{key("0123456789abcdef", 40)}" {word()}') for k in range(300)]
    plain = [
        lambda: f"{word()}_{word()}_{word()}_{draw.randrange(10, 99)}", lambda: f"{word()}-{word()}.{word()}/{word()}/{word()}", lambda: f'note: "{word()} {word()} {word()}"',
        lambda: f"{word().upper()}{word().upper()}THE", lambda: f"{word()}: {word()}{word()}ation", lambda: f"{draw.randrange(10**15, 10**16)}", lambda: f"10.{draw.randrange(99)}.7.12",
    ]
    rows += [(1000 + k, f"{word()} {word()} {plain[k % len(plain)]()} {word()}") for k in range(840)]
    held = {
        "upper": lambda: f'tok3n = "{key(UPPER[:6] + "0123456789", 40)}"', "no digit": lambda: f"passphrase: {key(UPPER + LOWER, 28)}",
        "low": lambda: f'key "{key(LOWER, 6)}" value="{key(LOWER, 32)}"', "long": lambda: f"blob={key(UPPER + LOWER + '0123456789+/', 130)}==", "short": lambda: f"pin= {key(UPPER + LOWER + '0123456789', 14)}",
    }
    hidden = {}
    for nth, (kind, make) in enumerate(held.items()):
        for k in range(12):
            i = 3000 + 100 * nth + k
            hidden[i] = kind
            rows.append((i, f"{word()} {word()} {make()} {word()}"))
    return rows, hidden


def test_network_finds_held_back_secrets(spark, leaks):
    """Other alphabets, without a digit, under other names, longer than a window, short ones."""
    rows, hidden = leaks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in secrets.detect(docs).collect()}
    for i, text in rows:
        base = [(secrets.KINDS[k], a, b) for a, b, k in brute.base_secrets(text)]
        assert [(s.kind, s.start, s.end) for s in got[i].base] == base
        assert [(s.kind, s.start, s.end) for s in got[i].spans if s.kind != "model"] == base
        assert all(s.score is not None for s in got[i].spans) and not (i >= 1000 and base)
    caught = Counter(hidden[i] for i in hidden if any(s.kind == "model" for s in got[i].spans))
    assert sum(caught.values()) >= 0.9 * len(hidden) and min(caught[k] for k in hidden.values()) >= 8, caught
    wrong = sum(any(s.kind == "model" for s in got[i].spans) for i in range(1000, 1840))
    assert wrong <= 6  # so nine of ten added spans are secrets


def test_candidates_are_read_whole():
    text = 'a="' + "x" * 30 + 'SECRET" ' + "k" * 100 + "Zq9 plainword short=ab1 v: abcdef MIXEDcase9"
    found = [text[a:b] for a, b in secrets.candidates(text)]
    assert found == ["x" * 30 + "SECRET", "k" * 100 + "Zq9", "short=ab1", "abcdef", "MIXEDcase9"]
    start, end = secrets.candidates(text)[1]
    windows = secrets.contexts(text, start, end)
    codes = np.frombuffer(windows, dtype=np.uint8).reshape(-1, secrets.WIDTH)[:, secrets.BEFORE : secrets.BEFORE + secrets.INSIDE]
    assert all(any(secrets._codes(text[k : k + 5]) in bytes(c) for c in codes) for k in range(start, end - 4))
    assert secrets.candidates("") == [] and secrets.candidates("plain words of prose only") == []


def test_threshold_keeps_the_recall_of_all_labelled_findings(spark, leaks):
    found = secrets.findings(spark.createDataFrame(leaks[0], "doc_id long, text string")).cache()
    known = [bytes(c.contexts) for r in found.collect() for c in r.candidates if c.known]
    model = {"network": secrets.Network(3).p, "slope": 1.0, "offset": 0.0}
    scores = secrets.candidate_scores(known, model, hide=True)
    for recall in (0.5, 0.95, 1.0):
        threshold = secrets.recall_threshold(found, model, recall)
        assert (scores >= threshold).mean() >= recall and (scores >= threshold + 2 * secrets.STEP).mean() < recall
    assert secrets.recall_threshold(found.limit(0), model) == 0.0


def test_secrets_of_edge_rows(spark, edge, empty):
    assert Counter(r.doc_id for r in secrets.detect(edge).collect()) == Counter(EDGE_IDS)
    assert secrets.detect(empty).count() == 0


# Mixing


def test_schedule_stays_within_a_block():
    parts = mixing.whole_parts({"a": 5, "b": 3, "c": 1.7, "d": "3/10"})
    assert parts == {"a": 50, "b": 30, "c": 17, "d": 3}
    slots, size = mixing.earliest_deadline_first(parts), sum(parts.values())
    assert sorted(s for own in slots.values() for s in own) == list(range(size))
    for name, own in slots.items():
        for t in range(size + 1):
            assert abs(sum(s < t for s in own) - t * parts[name] / size) < 1
        for j, s in enumerate(own):
            assert j * size // parts[name] <= s < -(-(j + 1) * size // parts[name])


def test_weights_without_a_short_period_are_refused():
    with pytest.raises(ValueError, match="slots"):
        mixing.whole_parts({"a": 2**0.5, "b": 1})


@pytest.mark.parametrize("weights", [{"a": 2, "b": 1}, mixing.default_weights({str(k): 1 + 37 * k for k in range(20)}), {"a": 0.99985, "b": 0.00015}])
def test_schedule_keeps_exact_weights_over_many_periods(weights):
    slots = 40_000
    rows = mixing.phases(dict.fromkeys(weights, slots), weights)
    order = {start + (b - first) // len(own) * size + own[(b - first) % len(own)]: s for s, first, end, start, size, own in rows for b in range(first, end)}
    share, taken = {s: w / sum(weights.values()) for s, w in weights.items()}, Counter()
    for t in range(slots):
        taken[order[t]] += 1
        assert all(abs(taken[s] - (t + 1) * w) < 1 + 1e-6 for s, w in share.items())


def test_sources_without_weight_come_last():
    rows = mixing.phases({"a": 3, "b": 2, "c": 4}, {"a": 0, "b": 1, "c": 1})
    assert sorted(start + k for s, first, end, start, *_ in rows if s == "a" for k in range(end - first)) == [6, 7, 8]


def test_every_block_has_one_slot_over_all_phases():
    counts = {"a": 700, "b": 40, None: 3, "c": 1}
    rows = mixing.phases(counts, {"a": 1, "b": 1, None: 2, "c": 0.1})
    placed = sorted(
        start + (b - first) // len(slots) * size + slots[(b - first) % len(slots)] for _, first, end, start, size, slots in rows for b in range(first, end)
    )
    assert placed == list(range(sum(counts.values())))
    for s, n in counts.items():
        parts = sorted((first, end) for name, first, end, *_ in rows if name == s)
        assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == n


@pytest.mark.parametrize("counts, weights", [({"a": 70, "b": 4, None: 3, "c": 1}, {"a": 1, "b": 1, None: 2, "c": 3}), ({"a": 5, "b": 9}, {"a": 0, "b": 0}), ({"a": 40, "b": 40, "c": 0}, {"a": 7, "b": 3, "c": 1})])
def test_phases_equal_a_slot_by_slot_schedule(counts, weights):
    want, seen = {}, Counter()
    for slot, s in enumerate(brute.pfair(counts, weights)):
        want[s, seen[s]] = slot
        seen[s] += 1
    got = {(s, b): start + (b - first) // len(own) * size + own[(b - first) % len(own)] for s, first, end, start, size, own in mixing.phases(counts, weights) for b in range(first, end)}
    assert got == want and seen == Counter(counts)


@pytest.mark.parametrize("name, block, weights", [("documents", 2_000, None), ("documents", 16_384, {f"src{k}": k % 3 for k in range(20)}), ("edge", 500, None)])
def test_order_equals_brute_force(request, name, block, weights):
    docs = request.getfixturevalue(name)
    rows = docs.select(mixing._key(mixing.SEED, "doc_id", "source", "text"), "doc_id", "source", "text").collect()
    full = None if weights is None else {r[2]: weights.get(r[2], Fraction(sum(weights.values()), len(weights))) for r in rows}
    want = [(slot, within, key, row[1], row[2]) for slot, within, key, row in brute.mixed([tuple(r) for r in rows], block, full)]
    got = sorted(mixing.order(docs, weights=weights, block_chars=block).collect(), key=lambda r: r.position)
    assert [(r.slot, r.key, r.doc_id, r.source) for r in got] == [(w[0], *w[2:]) for w in want]
    assert [r.position for r in got] == list(range(len(want)))


def test_order_holds_all_documents(documents, edge, empty):
    rows = mixing.order(documents, block_chars=2_000).collect()
    assert sorted(r.position for r in rows) == list(range(documents.count()))
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in documents.collect())
    by_position = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in by_position] == sorted(r.slot for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += max(r.chars, 1)
    weights = {s: n**0.5 for s, n in sizes.items()}
    slots = {r.slot: r.source for r in rows}
    assert len(slots) == len({(r.source, r.block) for r in rows}) and set(sizes) == set(weights)
    assert Counter(r.doc_id for r in mixing.order(edge).collect()) == Counter(EDGE_IDS)
    assert mixing.order(empty).count() == 0


def test_mixed_documents_are_in_order(documents, edge, empty):
    order = {r.doc_id: (r.slot, r.position) for r in mixing.order(documents, weights={"src1": 3.0}).collect()}
    out = mixing.mixed(documents, weights={"src1": 3.0})
    got = [r.doc_id for r in out.collect()]
    assert out.columns == documents.columns and sorted(got) == sorted(order)
    assert [order[i][0] for i in got] == sorted(o[0] for o in order.values())
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and Counter(r.doc_id for r in out.collect()) == Counter(EDGE_IDS)
    assert mixing.mixed(empty).count() == 0


def test_running_total_over_groups_and_parts(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["a", "b", None]), k, draw.randrange(9)) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, k long, n long").repartition(7)
    want, sums = [], Counter()
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        want.append((g, k, sums[g]))
        sums[g] += n
    assert collected(running_total(frame, "n", ["k"], ["g"]), "g", "k", "before") == sorted(want, key=repr)


# Language


def test_held_out_language(documents, edge, empty):
    model = langid.fit(documents)
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.predict(documents, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    assert (model["weights"] == 0).mean() > 0.3  # the elastic net leaves a sparse model
    edges = Counter((r.doc_id, r.lang_pred == "und") for r in langid.predict(edge, model).collect())
    assert edges == Counter((e[0], not any(c.isalpha() for c in e[1] or "")) for e in EDGE_TEXTS)
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}


def test_features_are_hashed_n_grams():
    one, many = langid.counts_of("ab"), langid.counts_of("Ab! ab?")
    assert one[1].sum() == 4 + 3 + 2 and many[1].sum() == 7 + 6 + 5
    assert langid.counts_of("1234 !?") is None and langid.counts_of("") is None and langid.counts_of(None) is None


def test_temperature_lowers_the_loss():
    draw = np.random.default_rng(1)
    labels = draw.integers(0, 3, 500)
    scores = draw.normal(0, 1, (500, 3)) * 8
    scores[np.arange(500), labels] += 6
    heat = langid.temperature(scores, labels)
    loss = lambda t: -np.log(langid._softmax(scores / t)[np.arange(500), labels]).mean()
    assert heat > 1.5 and loss(heat) < loss(1.0)
