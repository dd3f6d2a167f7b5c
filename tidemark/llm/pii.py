"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers find the bounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Kinds in the order in which spans at one place are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
#: Cues of an account, key or document number that follows them.
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "password", "secret", "api_key", "api-key", "apikey", "user id", "user_id", "customer id", "customer_id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"(?:[A-Za-z0-9._%+~-]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`{}|\\^]*)?")
HANDLE = re.compile(r"@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.-]*@)(?![A-Za-z0-9_])")
#: After a cue: a sign, perhaps quotes, and a value with dots only inside; what it may hold is checked apart.
VALUE = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|id|code|#))?[ \t]*[:=#][ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9_+/=-]*(?:\.[A-Za-z0-9_+/=-]+)*)", re.IGNORECASE)
#: After a cue: perhaps a word, a sign and quotes, and what may be an IBAN, whole or printed in groups.
IBAN = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|code|is|#))?[ \t]*[:=#]?[ \t]*[\"'(]?([A-Za-z]{2}[0-9]{2}(?:[ \u00a0\u202f-]?[A-Za-z0-9]){11,30})", re.IGNORECASE | re.ASCII)
#: Characters of an IBAN by country; others may have 15 to 34.
IBAN_SIZES = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 "
        "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
        "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text with A-Z small; other letters stay, so that places do not move."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN at ``start`` ends, at most at ``end``; 0 if none has its country's length and a valid checksum."""
    at = [i for i in range(start, end) if text[i].isalnum()]
    code = "".join(text[i] for i in at).upper()
    size = IBAN_SIZES.get(code[:2])
    for n in (size,) if size else range(len(at), 14, -1):
        if n <= len(at) and not text[at[n - 1] + 1 : at[n - 1] + 2].isalnum() and int("".join(str(int(c, 36)) for c in code[4:n] + code[:4])) % 97 == 1:
            return at[n - 1] + 1
    return 0


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all personal data of a text, by start and then kind.

    Each kind's expansion begins where its last one ended, whether or not that one was valid, so base kinds
    are the leftmost non-overlapping matches of their patterns without those that fail their check.  An account's
    value goes on to its end, however long; one that is no valid IBAN still counts by the rule of other values.
    """
    out = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (kind, size) in automaton().iter(lowered(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_end:
                run = DOTTED.match(text, at)
                ip_end = run.end()
                if run.group().count(".") >= 3:
                    start, parts = at, run.group().split(".")
                    for i in range(0, len(parts) - len(parts) % 4, 4):
                        four = parts[i : i + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                            out.append((start, end, 1))
                        start = end + 1
            if at >= card_end:
                run = CARD.match(text, at)
                card_end = run.end() if run else at + 1
                if run and len(run.group()) >= 12:
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, run.end(), 2))
            if at - 1 >= phone_end and text[at - 1] == "+" and (run := PHONE.match(text, at - 1)):
                phone_end = run.end()
                if 9 <= sum("0" <= c <= "9" for c in run.group()) <= 15:
                    out.append((at - 1, phone_end, 3))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            run = DOMAIN.match(text, at + 1) if start < at else None
            if run:
                email_end = run.end()
                out.append((start, email_end, 0))
            elif at >= account_end and (not at or not (text[at - 1].isalnum() or text[at - 1] in "._%+-@")) and (run := HANDLE.match(text, at)):
                account_end = run.end()
                out.append((at, account_end, 5))
        elif kind == "scheme":
            if at >= url_end and (run := URL.match(text, last + 1)):
                url_end = last + 1 + len(run.group().rstrip(".,;:!?)]"))
                out.append((at, url_end, 4))
        elif at >= account_end and (not at or not text[at - 1].isalnum()):
            if (run := IBAN.match(text, last + 1)) and (end := iban_end(text, *run.span(1))):
                account_end = end
                out.append((run.start(1), end, 5))
            elif (run := VALUE.match(text, last + 1)) and len(run.group(1)) >= 6 and any(c.isdigit() for c in run.group(1)):
                account_end = run.end(1)
                out.append((run.start(1), account_end, 5))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    out, done, at = [], 0, 0
    for a, b, k in found:
        if a >= done:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
        at = done
    return "".join([*out, text[at:]])


def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            found = [spans(x.as_py()) for x in part.column(1)]
            base = [[x for x in f if x[2] < 4] for f in found]
            counts = {f"n_{kind}": pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k, kind in enumerate(KINDS)}
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0),
                    **counts,
                    "base_sha256": pa.array([hashlib.sha256(told(f).encode()).hexdigest() for f in base], pa.string()),
                    "spans": pa.array([told(f) for f in found], pa.string()),
                }
            )


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: one row per input row with counts for each kind.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, n_url, n_account (long), base_sha256 (of the spans of the
    first four kinds) and spans (``kind:start:end``, code points, end exclusive, comma-joined by start and kind).

    A null text counts as empty; null and repeated ids are returned as they come; other columns are ignored;
    an empty table stays empty.  No shuffle.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.mapInArrow(tidy(detect), f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced by its kind; ``length_col``, where it is a column,
    gets the new length.  Rows, order of columns and nulls stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted(t, spans(t)) for x in batch.column(at)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if long is not None:
                lengths = [old.as_py() if t is None else len(t) for t, old in zip(texts, batch.column(long), strict=True)]
                batch = batch.set_column(long, batch.schema.field(long), pa.array(lengths, batch.schema.field(long).type))
            yield batch

    at = df.columns.index(text_col)
    long = df.columns.index(length_col) if length_col in df.columns else None
    return df.mapInArrow(tidy(run), df.schema)
