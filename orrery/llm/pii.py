"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs before a digit,
digits joined by a dot, digits side by side or joined by a space or hyphen, capitals before
two digits, schemes of addresses, and cue words of identifiers. From each anchor a deterministic parser of its
kind expands to both sides, to the longest run that its grammar allows, and validates the
result (octets, Luhn, digit counts, mod 97). An anchor inside a span that its kind has
already read, whether it was accepted or not, is not read again, which makes the spans the
leftmost ones that don't overlap.

Kinds, in order: email, ip, card, phone; then those that the method adds: address (a URL
that carries a user name or password), iban (validated account numbers) and account (the
value after a cue such as "token =").

Defined cases: a null or empty text has no spans; repeated rows are each scanned; a table
without rows gives none. Other columns are carried by `redact` and not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from .text import through_pandas

KINDS = ("email", "ip", "card", "phone", "address", "iban", "account")
BASE = KINDS[:4]
RANK = {kind: k for k, kind in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = CAPITALS | frozenset("abcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | set("._%+-")

#: Schemes of addresses, and cues before an identifier.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "git://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://")
CUES = ("token", "api_key", "apikey", "api-key", "access_key", "secret", "secret_key", "password", "passwd", "pwd", "account", "account_no", "acct", "iban", "passport", "ssn", "client_secret")

CUE_VALUE = re.compile(r"[\x20\t]*(?:number|no\.?|nr\.?|#)?[\x20\t]*[:=][\x20\t]*([\"'`]?)([A-Za-z0-9_+/.\-]{8,}=*)", re.ASCII)
ADDRESS = re.compile(r"([^\s\"'<>/?#@:]+)(?::([^\s\"'<>/?#@]*))?@[A-Za-z0-9.-]+[^\s\"'<>]*")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Built by rule: digit pairs with each joint, digits after a plus sign, capitals before two digits, schemes and cues in their cases."""
    found: dict[str, set[str]] = {"@": {"@"}}

    def add(pattern: str, kind: str) -> None:
        found.setdefault(pattern, set()).add(kind)

    for a in DIGITS:
        add("+" + a, "+")
        for b in DIGITS:
            add(a + "." + b, ".")
            for joint in ("", " ", "-"):
                add(a + joint + b, "d")
            for letter in CAPITALS:
                add(letter + a + b, "i")
    for scheme in SCHEMES:
        add(scheme, "s")
        add(scheme.upper(), "s")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            add(form, "c")
    machine = ahocorasick.Automaton()
    for pattern, kinds in found.items():
        for kind in kinds:
            machine.add_word(pattern, (kind, len(pattern)))
    machine.make_automaton()
    return machine


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels, n = at + 1, 0, len(text)
    while True:
        here = end
        while here < n and text[here] in LABEL:
            here += 1
        if here == end:
            end -= 1  # the dot before an empty label is not part of it
            break
        end, labels = here, labels + 1
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def _ip(text: str, dot: int, done: int) -> tuple[int, int, bool] | None:
    """The run of four numbers around a dot, and whether they are octets."""
    start, n = dot, len(text)
    while start > done and text[start - 1] in DIGITS:
        start -= 1
    if start == dot:
        return None
    end, parts = start, []
    while len(parts) < 4:
        here = end
        while here < n and text[here] in DIGITS:
            here += 1
        if here == end:
            return None
        parts.append(text[end:here])
        end = here
        if len(parts) < 4:
            if end < n and text[end] == ".":
                end += 1
            else:
                return None
    return start, end, all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)


def _digit_chain(text: str, at: int, done: int) -> tuple[int, int]:
    """The longest chain of digits with single spaces or hyphens between them."""
    start, end, n = at, at + 1, len(text)
    while start > done:
        if text[start - 1] in DIGITS:
            start -= 1
        elif text[start - 1] in " -" and start - 2 >= done and text[start - 2] in DIGITS:
            start -= 2
        else:
            break
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _is_card(run: str) -> bool:
    digits = run.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, plus: int) -> tuple[int, int, int] | None:
    """The run after a plus sign up to its last digit, and how many digits it has."""
    end, last, digits, n = plus + 2, 0, 1, len(text)
    while end < n and (text[end] in DIGITS or text[end] in " ().-"):
        if text[end] in DIGITS:
            digits += 1
            last = end
        end += 1
    return (plus, last + 1, digits) if last >= plus + 3 else None


def _is_iban(run: str) -> bool:
    plain = run.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and then by kind."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(("email", "ip", "card", "phone", "address", "iban", "account"), 0)
    for last, (kind, size) in anchors().iter(text):
        first = last - size + 1
        if kind == "d":
            if first >= done["card"]:
                start, end = _digit_chain(text, first, done["card"])
                done["card"] = end
                if _is_card(text[start:end]):
                    found.append(("card", start, end))
        elif kind == ".":
            if first >= done["ip"] and (run := _ip(text, first + 1, done["ip"])):
                done["ip"] = run[1]
                if run[2]:
                    found.append(("ip", run[0], run[1]))
        elif kind == "@":
            if first >= done["email"] and (run := _email(text, first, done["email"])):
                done["email"] = run[1]
                found.append(("email", *run))
        elif kind == "+":
            if first >= done["phone"] and (run := _phone(text, first)):
                done["phone"] = run[1]
                if 10 <= run[2] <= 15:
                    found.append(("phone", run[0], run[1]))
        elif kind == "s":
            if first >= done["address"] and (m := ADDRESS.match(text, last + 1)):
                done["address"] = m.end()
                found.append(("address", first, m.end()))
        elif kind == "i":
            if first > done["iban"] and (m := IBAN.match(text, first - 1)):
                # the run may have gone on into the words that follow: try its ends from the last
                ends = [e for e in range(m.end(), m.start() + 14, -1) if e == m.end() or text[e] == " "]
                if end := next((e for e in ends if _is_iban(text[m.start() : e])), 0):
                    done["iban"] = end
                    found.append(("iban", m.start(), end))
        elif first >= done["account"]:
            before = text[first - 1] if first else " "
            if not (before.isalnum()) and (m := CUE_VALUE.match(text, last + 1)) and any(c in DIGITS for c in m[2]):
                done["account"] = m.end(2)
                found.append(("account", m.start(2), m.end(2)))
    return sorted(found, key=lambda s: (s[1], RANK[s[0]]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                every = spans(t or "")
                base = [s for s in every if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])], axis=1)

    cut = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    return through_pandas(cut, run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, under the first's name."""
    parts, at = [], 0
    for kind, start, end in spans(text):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns as they are, but for the text; null texts stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else redacted(t))

    return df.withColumn(text, pandas_udf(run, "string")(df[text]))
