"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each whole text once and reports anchors: at-signs, digits, plus signs, scheme
separators and identifier cues. Deterministic parsers expand an anchor to the left and right, find the boundaries and
validate. Between anchors no Python runs.

Base kinds, each leftmost and non-overlapping by itself: email, ip (parts at most 255), card (14 to 19 digits, Luhn),
phone (10 to 15 digits). Kinds that the method adds: url (a web, file-transfer or mail address after its scheme), iban
(country letters, check digits and the checksum of 97) and account (an identifier after a cue such as "account no" that is
no part of a longer word). Schemes are found in any case of letters.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import SPAN, base_of, count_kind, joined, small_batches, tidy

#: Fixed order of kinds at equal starts.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
#: Fixed anchors of the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "account no", "account number", "acct", "iban", "ssn", "passport no", "customer id", "routing no")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
_DIGITS = frozenset("0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PHONE = frozenset(" ().0123456789-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:[:#=.]|is)?){0,2}[ \t]*([A-Z]{0,3}[0-9][0-9-]{4,32}[0-9])(?![A-Za-z0-9])")


def _cases(word: str) -> set[str]:
    """The word in every case of its letters if these are few, else in the usual ones."""
    if sum(map(str.isalpha, word)) <= 6:
        return set(map("".join, itertools.product(*({c, c.upper()} for c in word))))
    return {word, word.upper(), word.capitalize(), word.title()}


def automaton() -> ahocorasick.Automaton:
    """Anchors with what each calls for: (kind, anchor length)."""
    a = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in "0123456789")]:
        a.add_word(word, (kind, len(word)))
    for words, kind in ((SCHEMES, "s"), (CUES, "c")):
        for word in words:
            for form in _cases(word):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str, int, bool]]:
    """(start, kind's rank, kind, end, is it base) in no order; offsets are code points, ends exclusive."""
    out: list[tuple[int, int, str, int, bool]] = []
    n = len(text)
    email_end = ip_end = card_end = run_end = url_end = account_end = iban_end = 0

    def iban(at: int) -> None:
        nonlocal iban_end
        if at >= iban_end and (m := _IBAN.match(text, at)):
            s = m[0]
            while len(s) >= 15 and not _iban_ok(s):
                s = s[: s.rfind(" ")] if " " in s else ""
            if s:
                iban_end = at + len(s)
                add("iban", at, iban_end, False)

    def add(kind: str, start: int, end: int, base: bool) -> None:
        out.append((start, KINDS.index(kind), kind, end, base))

    for last, (what, size) in anchors.iter(text):
        if what == "0":
            if last < run_end:  # inside a run of digits that is done
                continue
            run_end = last + 1
            while run_end < n and text[run_end] in _DIGITS:
                run_end += 1
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    add("card", last, card_end, True)
            if last >= ip_end and run_end < n and text[run_end] == "." and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
                    add("ip", last, ip_end, True)
            if run_end - last >= 2 and last >= 2 and text[last - 1] in _UPPER and text[last - 2] in _UPPER and not text[last - 3 : last - 2].isalnum():
                iban(last - 2)  # country letters before the check digits
        elif what == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                add("email", start, email_end, True)
        elif what == "+":
            at = last + 1
            if at < n and text[at] in _DIGITS:
                end = at + 1
                while end < n and text[end] in _PHONE:
                    end += 1
                while text[end - 1] not in _DIGITS:
                    end -= 1
                if end - at >= 3 and 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    add("phone", last, end, True)
        elif what == "s":
            start = last - size + 1
            if start >= url_end and (m := (_MAILBOX if text[last] == ":" else _URL).match(text, last + 1)) and "." in m[0]:
                url_end = last + 1 + len(m[0].rstrip(".,;:!?)"))
                add("url", start, url_end, False)
        elif last + 1 >= account_end and not text[max(0, last - size) : last - size + 1].isalnum():
            m = _ACCOUNT.match(text, last + 1)
            if m:
                account_end = m.end(1)
                add("account", m.start(1), account_end, False)
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every span of each row's whole text, sorted by start, then kind.

    One output row per input row, repeated rows too. A null or empty text has no span; a text of any length is read whole;
    an empty table gives an empty result. Other columns aren't returned and may have any name.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        names = [f.name for f in SPAN.fields]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            spans = [[dict(zip(names, s, strict=True)) for s in sorted(found)] if (found := find(t, anchors)) else [] for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    return small_batches(source).mapInArrow(tidy(scan), schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.col("spans")
    counts = [count_kind(spans, k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base_of(spans)), 256).alias("base_sha256"), joined(spans).alias("spans"))
