"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, text_of

#: Kinds of the base, then those that the method adds, in the order of the results.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: How sure a confirmed span of a kind is without any context.
CERTAIN = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.45}
#: Words that, within ``REACH`` characters before or after a span, make it likelier.
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "api", "key"),
}
#: Words that make it less likely.
AGAINST = {"ip": ("version", "release"), "card": ("isbn", "order", "serial"), "phone": ("isbn",), "ssn": ("part", "model")}
REACH, MORE, LESS = 40, 0.3, 0.3
#: Added kinds are reported from this score on; the base is always reported.
THRESHOLD = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a start inside a run of digits cannot match where the run's own start cannot
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Fa-f0-9]{32,128}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_])")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check digits of account numbers: letters count 10 to 35, the remainder is 1."""
    text = text.replace(" ", "")
    rest = 0
    for c in text[4:] + text[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long words cost no more than once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 3 or len(p) == 3 and p <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, by kind and start; matches that fail their check are gone."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


#: Characters of an account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers; upper-case words that follow one are no part of it.

    Of a match, the beginning as long as numbers of its country are counts if it ends with a word and
    has valid check digits, else the longest that does.
    """
    found, at = [], 0
    while m := _IBAN.search(text, at):
        size = lambda e: len(text[m.start():e].replace(" ", ""))
        words = [e for e in range(m.end(), m.start(), -1) if e == m.end() or text[e] == " "]
        words.sort(key=lambda e: size(e) != IBAN_LENGTHS.get(m[0][:2]))
        end = next((e for e in words if 15 <= size(e) <= 34 and mod97(text[m.start():e])), None)
        if end is not None:
            found.append((m.start(), end))
        at = end or m.start() + 2
    return found


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Account numbers with valid check digits, social security numbers and secrets."""
    out = [("iban", a, b) for a, b in _ibans(text)]
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append(("ssn", m.start(), m.end()))
    return out + [("secret", m.start(), m.end()) for m in _SECRET.finditer(text)]


def score(text: str, kind: str, start: int, end: int) -> float:
    """How sure a confirmed span is, given the words around it."""
    near = (text[max(0, start - REACH):start] + " " + text[end:end + REACH]).lower()
    value = CERTAIN[kind]
    value += MORE * any(re.search(rf"(?<![a-z]){w}", near) is not None for w in CONTEXT[kind])
    value -= LESS * any(re.search(rf"(?<![a-z]){w}", near) is not None for w in AGAINST.get(kind, ()))
    return min(1.0, max(0.0, value))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans as ``kind, start, end, score``, by kind as listed in ``KINDS``, then start."""
    found = [(*s, score(text, *s)) for s in base_spans(text)]
    for s in added_spans(text):
        sure = score(text, *s)
        if sure >= THRESHOLD:
            found.append((*s, sure))
    return found


def _found(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "score")
    for batch in batches:
        rows = [[dict(zip(names, s)) for s in spans(t)] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(rows, kind)], names=["row", "spans"])


def found(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row, spans``: code points, end exclusive.  Null and empty texts have none."""
    rows = packed(docs, text_of().alias("text"), keep=keep)
    kinds = rows.select("row", F.array(F.struct(
        F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score")
    )).alias("spans"))
    return rows.mapInArrow(_found, kinds.schema)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets.

    Of spans that overlap, the one that starts first, then the longer one, is masked.
    """
    cut = F.aggregate(
        F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], -s["end"], s["end"].alias("e"), s["kind"].alias("k")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["e"].alias("at"),
            F.concat(a["out"], F.substr(F.col("text_"), a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["k"], F.lit(">")).alias("out"),
        )),
    )
    some = found(docs).select("row", "spans", text_of(F.col("row.text")).alias("text_")).withColumn("cut", cut)
    text = F.concat(F.col("cut.out"), F.substr("text_", F.col("cut.at") + 1, F.length("text_")))
    whole = F.when(F.size("spans") > 0, text).otherwise(F.col("row.text"))
    return some.select(*(whole.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
