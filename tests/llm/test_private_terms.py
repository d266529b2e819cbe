"""Personal data against Python's patterns; terms by hand-made co-occurrence."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from evalframe.llm import private_terms
from evalframe.llm.queries import op2_private_terms

# The patterns as the contract states them.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def plain(text):
    found = [[(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in BASE]
    joined = ",".join(f"{k}:{s}:{e}" for (k, _), spans in zip(BASE, found) for s, e in spans)
    return (*(len(s) for s in found), hashlib.sha256(joined.encode()).hexdigest(), joined)


ODD = [
    None, "", "a@b.c", "a@b.c+d@e.f", "x.y@z", "a@b@c.d.e", "é a%b+c@x-y.z.co, (q@r.st)", "@a.b", "a@b.c@d.e",
    "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0255.1.1.001", "1.2.3", "1.2.3.99999999999999999999", "11.2.3.4.5.6.7.8",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111", "4111  1111 1111 1111",
    "6011000990139424000", "+1 (650) 555-0100", "+1 2", "+12345678", "+1234567890123456", "++1 650 555 0100.", "+1-650-555-0100x",
    "𝄞 😀 mail me@here.org or call +49 30 901820 from 192.168.0.1 😀 5500 0000 0000 0004", "9" * 60_000, "a" * 60_000 + "@",
    "1 " * 30_000, "a@b" + ".c" * 20_000,
]


def test_base_spans(docs_of):
    rows = list(enumerate(ODD)) + [(None, "n@u.ll"), (3, "a@b.c")]
    got = private_terms.spans(docs_of(rows), "doc_id", "text").collect()
    want = sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert sorted(((r["key"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in got),
                  key=repr) == want


def test_terms_beside_an_entity(docs_of):
    rows = [(i, f"Dr Zyxel writes from zyxel@lab.org to the group number {i}") for i in range(4)]
    rows += [(10 + i, f"the group writes to number {i} from home") for i in range(400)]
    rows += [(500 + i, f"user{i} writes to u{i}@x.org from home") for i in range(20)]
    docs = docs_of(rows)
    got = {r["key"]: r for r in private_terms.spans(docs, "doc_id", "text").collect()}
    assert got[0]["spans"] == "email:21:34,term:0:2,term:3:8"  # "writes", "from", "to" and "the" stand everywhere
    assert all(got[i]["n_term"] == 2 for i in range(4)) and all(got[i]["n_term"] == 0 for i, _ in rows[4:])
    clean = {r["doc_id"]: r["text"] for r in private_terms.sanitised(docs, "doc_id", "text").collect()}
    assert clean[0] == "<TERM> <TERM> writes from <EMAIL> to the group number 0"
    assert clean[10] == rows[4][1] and clean[500] == "user0 writes to <EMAIL> from home"


def test_terms_far_from_the_entity(docs_of):
    far = "the group writes from home to number after number and rests " * 50
    rows = [(i, f"Zyxel {far}zyxel@lab.org {far}Zyxel {i}") for i in range(4)]
    rows += [(10 + i, f"the group writes to number {i} from home after it rests and goes") for i in range(400)]
    got = {r["key"]: r for r in private_terms.spans(docs_of(rows), "doc_id", "text").collect()}
    last = len("Zyxel  ") + len("zyxel@lab.org") + 2 * len(far)
    assert all(got[i]["spans"].split(",")[1:] == ["term:0:5", f"term:{last}:{last + 5}"] for i in range(4))
    assert all(got[i]["n_term"] == 0 for i, _ in rows[4:])
    clean = {r["doc_id"]: r["text"] for r in private_terms.sanitised(docs_of(rows), "doc_id", "text").collect()}
    assert clean[0] == f"<TERM> {far}<EMAIL> {far}<TERM> 0"


def test_terms_of_frequent_and_of_rare_entities(docs_of):
    rows = [(i, f"Ypsilon asks desk@all.org about number {i}") for i in range(100)]
    rows += [(200 + i, f"somebody asks about number {i}") for i in range(196)]
    rows += [(500 + i, f"Omikron asks rare@one.org about number {i}") for i in range(2)]
    rows += [(600, "Alone asks single@one.org about number 1"), (601, "somebody asks about desk@all.org")]
    got = {r["key"]: r["spans"].split(",") for r in private_terms.spans(docs_of(rows), "doc_id", "text").collect()}
    assert all("term:0:7" in got[i] and len(got[i]) == 2 for i in range(100))  # an entity in a third of the rows
    assert all("term:0:7" in got[500 + i] and len(got[500 + i]) == 2 for i in range(2))
    assert len(got[600]) == 1 and len(got[601]) == 1  # one document, or a term that is mostly elsewhere, tells nothing


def test_sanitised_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "+1 650 555 0100 and a@b.c"), (3, "+1 650 555 0100 and a@b.c"), (None, "x 1.2.3.4 y")]
    docs = docs_of(rows).withColumn("pii", F.lit("p")).withColumn("_row", F.lit(1)).withColumn("came", F.lit(2))
    out = private_terms.sanitised(docs, "doc_id", "text")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["pii"]) for r in out.collect()), key=repr) == sorted([
        (1, None, "p"), (2, "", "p"), (3, "<PHONE> and <EMAIL>", "p"), (3, "<PHONE> and <EMAIL>", "p"), (None, "x <IP> y", "p")], key=repr)


def test_empty_table(docs_of):
    assert private_terms.spans(docs_of([]), "doc_id", "text").collect() == []
    assert private_terms.sanitised(docs_of([]), "doc_id", "text").collect() == []


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_private_terms(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[:5]
        assert r["spans"].startswith(want[5])
