"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and the cue
words of identifiers. Local parsers walk outwards from each anchor, fix the boundaries and validate.
Offsets are code points, ends exclusive. Null texts count as empty; empty texts have no spans;
repeated rows are kept, and columns of any name. Cues inside a value found before them are part of it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Kinds in the order in which spans are listed; the base kinds first.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "account", "ssn", "secret"]
#: Cue words, each tried in lower case, upper case and with a capital.
ACCOUNT_CUES = ["account", "acct", "konto", "kontonummer", "cuenta", "compte"]
SSN_CUES = ["ssn", "social security"]
SECRET_CUES = ["password", "passwd", "passwort", "token", "secret", "api_key", "apikey", "api-key"]

DIGITS = frozenset("0123456789")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = WORD | set("._%+-")
LABEL = WORD | {"-"}
PHONE = DIGITS | set(" ().-")
URL_END = frozenset(" \t\n\r\v\f\"'<>|\\^`{}")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    for kind, words in (("at", ["@"]), ("plus", ["+"]), ("scheme", ["://"]), ("www", ["www."])):
        for w in words:
            found.add_word(w, (kind, len(w)))
    for kind, words in (("iban", ["iban"]), ("account", ACCOUNT_CUES), ("ssn", SSN_CUES), ("secret", SECRET_CUES)):
        for w in {f(w) for w in words for f in (str.lower, str.upper, str.capitalize)}:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    out, last, n = [], 0, len(text)
    for at in ats:
        if at < last:
            continue
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end, labels = at + 1, 0
        while True:
            stop = end
            while stop < n and text[stop] in LABEL:
                stop += 1
            if stop == end:
                end -= labels > 0  # the dot before an empty label
                break
            labels, end = labels + 1, stop
            if end < n and text[end] == ".":
                end += 1
            else:
                break
        if start < at and labels > 1:
            out.append((start, end))
            last = end
    return out


def runs(positions: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in positions:
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def chains(text: str, numbers: list[tuple[int, int]], between: str) -> list[list[tuple[int, int]]]:
    """Runs of digits that are one separator apart."""
    out: list[list[tuple[int, int]]] = []
    for a, b in numbers:
        if out and out[-1][-1][1] + 1 == a and text[a - 1] in between:
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    out = []
    for p in pluses:
        if p + 1 >= len(text) or text[p + 1] not in DIGITS:
            continue
        stop = p + 2
        while stop < len(text) and text[stop] in PHONE:
            stop += 1
        while stop > p + 3 and text[stop - 1] not in DIGITS:
            stop -= 1
        if stop > p + 3 and 9 <= sum(c in DIGITS for c in text[p:stop]) <= 15:
            out.append((p, stop))
    return out


def urls(text: str, hits: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for kind, start, stop in hits:
        if out and start < out[-1][1]:
            continue
        first = start
        if kind == "scheme":
            while first and text[first - 1] in WORD:
                first -= 1
            if text[first:start].lower() not in ("http", "https", "ftp"):
                continue
        elif first and text[first - 1] in WORD:
            continue
        end = stop
        while end < len(text) and text[end] not in URL_END:
            end += 1
        while end > stop and text[end - 1] in ".,;:!?)]":
            end -= 1
        if end > stop:
            out.append((first, end))
    return out


def _skip(text: str, at: int, most: int, allowed: str) -> int:
    end = min(len(text), at + most)
    while at < end and text[at] in allowed:
        at += 1
    return at


def iban(text: str, at: int) -> tuple[int, int] | None:
    start = _skip(text, at, 4, " :#")
    kept, end, best = "", start, None
    while end < len(text) and len(kept) < 34 and (text[end] in WORD or text[end] == " " and text[end - 1] != " "):
        kept += text[end].strip()
        end += 1
        if len(kept) >= 15 and text[end - 1] != " " and kept[:2].isalpha() and kept[2:4].isdigit():
            if int("".join(str(int(c, 36)) for c in kept[4:] + kept[:4])) % 97 == 1:
                best = (start, end)
    return best


def account(text: str, at: int) -> tuple[int, int] | None:
    start = _skip(text, at, 3, " :#")
    for word in ("number", "no.", "no", "nr.", "nr"):
        if text[start : start + len(word)].lower() == word:
            start = _skip(text, start + len(word), 3, " :#")
            break
    end = _skip(text, start, 24, "0123456789-")
    while end > start and text[end - 1] == "-":
        end -= 1
    return (start, end) if 6 <= sum(c in DIGITS for c in text[start:end]) <= 17 and text[start] in DIGITS else None


def ssn(text: str, at: int) -> tuple[int, int] | None:
    start = _skip(text, at, 4, " :#")
    found = text[start : start + 11]
    good = len(found) == 11 and found[3] == found[6] and found[3] in "- " and all(c in DIGITS for i, c in enumerate(found) if i not in (3, 6))
    return (start, start + 11) if good and found[:3] not in ("000", "666") and found[4:6] != "00" and found[7:] != "0000" else None


def secret(text: str, at: int) -> tuple[int, int] | None:
    at = _skip(text, at, 3, " \"'")
    if at >= len(text) or text[at] not in "=:":
        return None
    start = _skip(text, at + 1, 4, " \"'>")
    end = start
    while end < len(text) and text[end] not in " \t\n\r\v\f\"'<>;,":
        end += 1
    return (start, end) if end - start >= 8 else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then by start."""
    if not text:
        return []
    hits: dict[str, list[tuple[str, int, int]]] = {}
    for last, (kind, size) in automaton().iter(text):
        hits.setdefault(kind, []).append((kind, last + 1 - size, last + 1))
    if not hits:
        return []
    places = lambda kind: [start for _, start, _ in hits.get(kind, [])]
    out = [("email", *x) for x in emails(text, places("at"))]
    numbers = runs(places("digit"))
    for chain in chains(text, numbers, "."):
        for four in (chain[i : i + 4] for i in range(0, len(chain) - 3, 4)):
            if all(octet(text[a:b]) for a, b in four):
                out.append(("ip", four[0][0], four[-1][1]))
    for chain in chains(text, numbers, " -"):
        if 13 <= sum(b - a for a, b in chain) <= 19 and luhn([int(c) for a, b in chain for c in text[a:b]]):
            out.append(("card", chain[0][0], chain[-1][1]))
    out += [("phone", *x) for x in phones(text, places("plus"))]
    out += [("url", *x) for x in urls(text, sorted(hits.get("scheme", []) + hits.get("www", []), key=lambda x: x[1]))]
    for kind, parse in (("iban", iban), ("account", account), ("ssn", ssn), ("secret", secret)):
        last = 0
        for _, start, end in hits.get(kind, []):
            if start >= last and (not start or text[start - 1] not in WORD) and (found := parse(text, end)):
                out.append((kind, *found))
                last = found[1]
    return out


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, an array of (kind, start, end), of every row."""
    schema = T.StructType([df.schema[key], T.StructField("spans", SPANS)])
    names = ("kind", "start", "end")

    def step(rows: dict) -> dict:
        return {key: rows[key], "spans": [[dict(zip(names, x)) for x in find_spans(t)] for t in rows[text]]}

    return map_arrow(df.select(key, text), step, schema, text)


def masked(text: str) -> str:
    """text with every span, or union of overlapping ones, replaced by the name of its first kind."""
    out, last = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in find_spans(text)):
        if start >= last:
            out += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, end)
    return "".join(out) + text[last:]


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the personal data in text masked; null texts stay null."""
    return map_arrow(df, lambda rows: rows | {text: [x if x is None else masked(x) for x in rows[text]]}, df.schema, text)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
