from __future__ import annotations

import re
import time

from corpus_cases import awkward, docs_of

from tapeworks.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def direct(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            if kind == "card":
                s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
                if not 16 <= len(d) <= 19 or s % 10:
                    continue
            out.append((kind, *m.span()))
    return out


CASES = ["a@b.c_d@e.f x@y@z.w @q.r me@h-1.co.uk. é.ü@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.0004 010.020.030.040 1.2.3.4444 12.34.56.78",
         "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (459) 555-9246. +12 +1()()()()()5 +44 20 7946 0958 123", "+" * 50 + "1 2 3",
         "ü" * 3 + "4929348385146306x", "a@b", "@", "1.2.3.", "++1 23456789", "0.0.0.0.0"]


def test_base_spans_are_the_patterns():
    for text in [*CASES, " ".join(CASES), "\n".join(reversed(CASES))]:
        assert pii.base_spans(text) == direct(text), text


def test_added_kinds_need_their_check():
    kinds = lambda t: [s[0] for s in pii.personal_spans(t)]
    assert "iban" in kinds("transfer to GB82 WEST 1234 5698 7654 32 today") and "iban" not in kinds("GB82 WEST 1234 5698 7654 33")
    assert "ssn" in kinds("her social security number 123-45-6789") and "ssn" not in kinds("part 123-45-6789")
    assert "short_card" in kinds("amex card 378282246310005") and "short_card" not in kinds("order 378282246310005")


def test_linear_on_long_runs():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000, "+1" * 100_000, "." * 200_000 + "@"):
        pii.personal_spans(text)
    assert time.time() - began < 20


def test_awkward_rows(spark):
    rows = [*awkward(), (500, "mail x@y.zz from 10.0.0.1", "en", "s", 0), (500, "mail x@y.zz from 10.0.0.1", "en", "s", 0)]
    docs = docs_of(spark, rows)
    got = pii.span_digest(pii.find_personal(docs)).collect()
    assert len(got) == len(rows)
    twice = [r for r in got if r["doc_id"] == 500]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["spans"] == "email:5:11,ip:17:25" and twice[0]["n_email"] == 1
    assert twice[0]["base_sha256"] == pii.span_hash(pii.personal_spans(rows[-1][1])) and {r["spans"] for r in got if r["doc_id"] != 500} == {""}
    assert {r["text"] for r in pii.mask_personal(docs).collect() if r["doc_id"] == 500} == {"mail <email> from <ip>"}
    assert pii.find_personal(docs_of(spark, [])).collect() == []
