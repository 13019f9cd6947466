"""Personal data, also where it is disguised, with spans in the source text.

Transducers rewrite a text step by step: look-alike characters to ASCII,
``(at)`` and ``dot`` to signs, spelled digits to digits. With each character of
the result goes the span of the source that it stands for, so an identifier
found in the rewritten text is reported where it stands in the source. What
the plain text shows by itself always stays; disguised finds are added where
they overlap none of their kind.

Spans are code points, end exclusive. A null text counts as empty. Every row
is scanned for itself, so rows and ids may repeat.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.licenses import words_of

KINDS = ("email", "ip", "card", "phone")  # the order of spans with one start

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """From each @ back over the local part: as the pattern would match, in linear time."""
    last = 0
    for match in DOMAIN.finditer(text):
        begin = match.start()
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < match.start():
            last = match.end()
            yield begin, last


def addresses(text: str) -> Iterator[Span]:
    for match in ADDRESS.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            yield match.span()


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[Span]:
    for match in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in match[0]) <= 15:
            yield match.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def detect(text: str) -> list[tuple[int, int, str]]:
    """(begin, kind number, end, kind) in the order of spans."""
    has_digit = re.search("[0-9]", text) is not None
    kinds = [k for k in KINDS if (k == "email" and "@" in text) or (k != "email" and has_digit)]
    return sorted((b, KINDS.index(k), e, k) for k in kinds for b, e in DETECTORS[k](text))


# --- transducers --------------------------------------------------------------

# Letters of other scripts that look like ASCII letters, and the letters they pass for.
LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοｏα",
    "ABESIJKMHOPCTXYaesijopcxydhqwABEZHIKMNOPTYXooa",
)
# Names of the digits in four languages.
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = re.compile("[­​‌‍⁠﻿]")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९！-～\u2100-\u214fⓐ-ⓩⒶ-Ⓩ\U0001d400-\U0001d7ff]")
NAME = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
AT = re.compile(r"(?:[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]|(?<=\w)[-_]at[-_](?=\w)|&#64;|&commat;|(?<=\w)%40(?=\w))", re.IGNORECASE)
DOT = re.compile(r"(?:[(\[{<]\s*(?:dot|\.|punkt|point|punto)\s*[)\]}>]|(?<=\w)[-_]dot[-_](?=\w)|&#46;|&period;)", re.IGNORECASE)
# letters that pass for digits, in a run that is mostly digits
PASSING = str.maketrans("OoIl", "0011")
MIXED = re.compile(r"(?<![A-Za-z0-9])(?:\+|)[0-9OoIl][0-9OoIl .()-]{5,}[0-9OoIl](?![A-Za-z0-9])")
MIXED_CUE = re.compile(r"[0-9][OoIl]|[OoIl][0-9]|[OoIl][ .-][0-9]")
# Ends of domains without which bare words are no address.
ENDS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|eu|de|at|ch|fr|es|it|nl|be|pl|pt|se|no|dk|fi|uk|ie|us|ca|au|nz|jp|cn|in|br|mx|ru|test|example"
SPOKEN = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]+(\s+at\s+|\s*@\s*)[A-Za-z0-9-]+"
    rf"((?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*\s+dot\s+(?:{ENDS}))(?!\w)",
    re.IGNORECASE,
)
SPOKEN_TAIL = re.compile(r"\s+dot\s+", re.IGNORECASE)
ONE_NAME = re.compile(rf"(?<!\w){NAME}(?!\w)", re.IGNORECASE)
NUMBER = re.compile(
    rf"(?:(?<!\w)plus\s+)?(?<!\w)(?:{NAME}|[0-9]+)(?:(?:[\s,-]+|\s+(?:dot|punkt|point|punto)\s+|\s*\.\s*)(?:{NAME}|[0-9]+)(?!\w)){{3,}}",
    re.IGNORECASE,
)


class Tape:
    """A text and, for each of its characters, the span of the source it stands for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans; what replaces one stands for all of it."""
        text, begin, end, last = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[last:a], new]
            begin += [*self.begin[last:a], *[self.begin[a]] * len(new)]
            end += [*self.end[last:a], *[self.end[b - 1]] * len(new)]
            last = b
        self.text = "".join([*text, self.text[last:]])
        self.begin, self.end = [*begin, *self.begin[last:]], [*end, *self.end[last:]]


def plain_letters(tape: Tape) -> None:
    """Look-alikes, other forms of ASCII letters and digits of other scripts; one character for one."""
    if FOREIGN.search(tape.text):
        def ascii_of(match: re.Match) -> str:
            c = match[0]
            digit = unicodedata.digit(c, None)
            if digit is not None:
                return str(digit)
            form = unicodedata.normalize("NFKC", c)  # full-width, mathematical, circled
            return form if len(form) == 1 and form.isascii() else c.translate(LOOKALIKES)

        tape.text = FOREIGN.sub(ascii_of, tape.text)


def digit_letters(tape: Tape) -> None:
    """O and l for 0 and 1 where at least two of three characters are digits; one for one."""

    def plain(match: re.Match) -> str:
        letters = sum(c in "OoIl" for c in match[0])
        return match[0].translate(PASSING) if 2 * letters <= sum(c.isdigit() for c in match[0]) else match[0]

    tape.text = MIXED.sub(plain, tape.text)


def visible(tape: Tape) -> None:
    """Without characters that show nothing."""
    if INVISIBLE.search(tape.text):
        tape.rewrite([(*m.span(), "") for m in INVISIBLE.finditer(tape.text)])


def with_blanks(pattern: re.Pattern, text: str) -> Iterator[Span]:
    """Matches with the white space around them; it is found from the match, so that runs of it are read once."""
    last = 0
    for match in pattern.finditer(text):
        a, b = match.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        yield a, b
        last = b


def signs(tape: Tape) -> None:
    """``(at)``, ``[dot]`` and, in a whole address, the bare words."""
    for pattern, sign in ((AT, "@"), (DOT, ".")):
        if edits := [(a, b, sign) for a, b in with_blanks(pattern, tape.text)]:
            tape.rewrite(edits)
    edits = []
    for match in SPOKEN.finditer(tape.text):
        edits.append((*match.span(1), "@"))
        edits += [(*m.span(), ".") for m in SPOKEN_TAIL.finditer(tape.text, *match.span(2))]
    if edits:
        tape.rewrite(edits)


def digits(tape: Tape) -> None:
    """Numbers of four and more spoken parts, with ``plus`` before and ``dot`` between."""
    edits = []
    for match in NUMBER.finditer(tape.text):
        if not ONE_NAME.search(match[0]):
            continue
        last = None
        for part in re.finditer(rf"plus(?!\w)|{NAME}(?!\w)|[0-9]+|dot|punkt|point|punto|\.", match[0], re.IGNORECASE):
            a, b = match.start() + part.start(), match.start() + part.end()
            word = part[0].lower()
            new = "+" if word == "plus" else "." if word in ("dot", "punkt", "point", "punto", ".") else DIGIT_NAMES.get(word, word)
            if last is not None and last < a:
                edits.append((last, a, ""))
            edits.append((a, b, new))
            last = b
    if edits:
        tape.rewrite(edits)


#: what ``signs`` rewrites begins with one of these; quick to search for
BRACKETED = re.compile(r"[(\[{<]\s*(?:at|@|arroba|dot|\.|punkt|point|punto)")
BARE = ("-at-", "_at_", "-dot-", "_dot_", "&#64;", "&commat;", "%40", "&#46;", "&period;")


NAMES = frozenset(name.encode() for name in DIGIT_NAMES)


def says_digits(low: str) -> bool:
    """Whether the name of a digit stands next to another one or to a number."""
    words = words_of(low.encode())
    if NAMES.isdisjoint(words):
        return False
    spoken = [word in NAMES for word in words]
    counts = [a or word.isdigit() for a, word in zip(spoken, words, strict=True)]
    return any((a and d) or (b and c) for a, b, c, d in zip(spoken, spoken[1:], counts, counts[1:], strict=False))


def has_cue(text: str) -> bool:
    """Whether a transducer may have work."""
    if not text.isascii() and (FOREIGN.search(text) or INVISIBLE.search(text)):
        return True
    low = text.lower()
    sign = MIXED_CUE.search(text) or BRACKETED.search(low) or any(bare in low for bare in BARE) or ("dot" in low and re.search(r"\sdot\s", low))
    return bool(sign) or says_digits(low)


def disguised(text: str, plain: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Spans that show only once the text is rewritten and overlap none of their kind."""
    if not has_cue(text):
        return []
    tape = Tape(text)
    for transducer in (plain_letters, visible, digit_letters, signs, digits):
        transducer(tape)
    if tape.text == text:
        return []
    taken = {k: sorted((b, e) for b, _, e, kind in plain if kind == k) for k in KINDS}
    added = []
    for b, number, e, kind in detect(tape.text):
        begin, end = tape.begin[b], tape.end[e - 1]
        if text[begin:end] != tape.text[b:e] and not any(x < end and begin < y for x, y in taken[kind]):
            added.append((begin, number, end, kind))
    return added


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for b, _, e, kind in spans)


COLUMNS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string"


def scan_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: counts and hash of the plain finds, ``n_added`` disguised ones, all spans."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                source = value.as_py() or ""
                plain = detect(source)
                added = disguised(source, plain)
                counts = [sum(kind == k for *_, kind in plain) for k in KINDS]
                sha = hashlib.sha256(joined(plain).encode()).hexdigest()
                rows.append((*counts, len(added), sha, joined(sorted(plain + added))))
            kinds = ["int64"] * 5 + ["string"] * 2
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scanned, COLUMNS)
