"""Ids of other types than long: every operator takes them, and gives the same answers."""

import random

import pytest
from tessella.llm import decontaminate, language, near_dup, packing, passages, quality_model, quality_rules, secrets, suffix, toxicity

LABELS = "quality int, toxic int"


def texts():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(900)}"
    out = [" ".join(word() for _ in range(90 + i)) for i in range(40)]
    passage = " ".join(word() for _ in range(90))
    out += [out[0], out[1] + " tail", f"{out[2]} {passage}", f"{out[3]} {passage}", "token = 'abcdef123456'", None, ""]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    item = " ".join(texts()[5].split()[10:24])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    made = {}
    for kind, name in (("long", lambda i: i), ("int", lambda i: i), ("string", lambda i: f"doc-{i:03d}"), ("string ", lambda i: f"{i:03d}")):
        rows = [(name(i), t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(texts())]
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string").repartition(3)
        labels = spark.createDataFrame([(name(i), i % 2, int(i % 7 == 0)) for i in range(30)], f"doc_id {kind}, {LABELS}")
        made[kind] = (docs.persist(), labels, name)
    return made, bench


def path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: What of each result does not depend on which id a row has (models learn from rows chosen by a hash of the id).
OPERATORS = {
    "packing": (lambda d, l, b: packing.pack(d, path()), ["piece", "start", "length", "ids_crc32"]),
    "toxicity": (lambda d, l, b: toxicity.result(d, l), []),
    "decontaminate": (lambda d, l, b: decontaminate.result(d, b), ["item_id", "edits", "from_byte", "to_byte"]),
    "clean": (lambda d, l, b: decontaminate.clean(d, b), ["lang", "source"]),
    "near_dup": (lambda d, l, b: near_dup.result(d), ["n_shingles", "component_id", "kept"]),
    "one_of_each": (lambda d, l, b: near_dup.one_of_each(d, 80), ["lang", "source"]),
    "language": (lambda d, l, b: language.result(d), []),
    "passages": (lambda d, l, b: passages.result(d), ["n_links", "n_copies"]),
    "suffix": (lambda d, l, b: suffix.result(d), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "quality_rules": (lambda d, l, b: quality_rules.result(d), ["n_words", "base_failed", "kept"]),
    "quality_model": (lambda d, l, b: quality_model.result(d, l), []),
    "secrets": (lambda d, l, b: secrets.result(d), ["n_assign", "spans"]),
}


@pytest.mark.parametrize("kind", ["int", "string", "string "])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ids_of_any_type(tables, name, kind):
    made, bench = tables
    run, columns = OPERATORS[name]
    docs, labels, named = made[kind]
    got = run(docs, labels, bench)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    ids = {"component_id"}
    want = run(*made["long"][:2], bench).collect()
    plain = sorted(str((named(r.doc_id), *[named(r[c]) if c in ids and r[c] is not None else r[c] for c in columns])) for r in want)
    assert sorted(str((r.doc_id, *[r[c] for c in columns])) for r in got.collect()) == plain
