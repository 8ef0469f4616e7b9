"""Redaction of account numbers, card numbers and secrets in message texts.

Texts without a digit skip Python: a native test decides, and only the others go through a pandas UDF,
in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIACRITICS, DIGITS_FROM, DIGITS_TO, INVISIBLE

# Separators inside numbers, keywords of secrets, limits of their neighbourhood.
SEPARATORS = "   –-"
SECRET_KEYWORDS = "CVV|CVC|PIN|OTP|one[- ]time password|verification code|access code|رمز التحقق|رمز الدخول|رمز التفعيل|رمز|الرقم السري|كلمة المرور"
NEAR_WORDS, NEAR_CHARS = 12, 120
IBAN_DIGITS = 22

_ASCII = str.maketrans(DIGITS_FROM, DIGITS_TO)
_HIDDEN = re.compile(f"[{INVISIBLE}{DIACRITICS}]")
_FOREIGN = re.compile(f"[{DIGITS_FROM}]")
_IBAN = re.compile(rf"SA(?:[{SEPARATORS}]?[0-9]){{{IBAN_DIGITS}}}", re.IGNORECASE)
_GROUPS = re.compile(rf"[0-9]{{2,}}(?:[{SEPARATORS}][0-9]{{2,}})*")
_RUN = re.compile("[0-9]{3,}")
# Letters and what else is one of them when case is ignored. A keyword's letters are spelt as classes, so that the search can jump to first letters.
_LETTERS = "A-Za-zİıſ\u212a"
_LATIN, _ARABIC = ([k for k in SECRET_KEYWORDS.split("|") if k[0].isascii() == latin] for latin in (True, False))
_cased = lambda word: re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}{dict(i='İı', s='ſ').get(m[0].lower(), '')}]", word)
_heads = lambda words: "".join(sorted({c for w in words for c in (w[0].upper(), w[0].lower())}))
_SECRET = re.compile(
    rf"[{_heads(_LATIN)}{_heads(_ARABIC)}](?:(?<=[{_heads(_LATIN)}])(?<![{_LETTERS}].)(?:{'|'.join(f'(?<={_cased(k[0])}){_cased(k[1:])}' for k in _LATIN)})(?![{_LETTERS}])|{'|'.join(f'(?<={k[0]}){k[1:]}' for k in _ARABIC)})"
)


def _view(text: str) -> tuple[str, list[int]]:
    """The text as it is searched: visible characters, ASCII digits; and, for each hidden one, how many visible ones stand before it."""
    if text.isascii():
        return text, []
    gone = [m.start() - n for n, m in enumerate(_HIDDEN.finditer(text))]
    view = _HIDDEN.sub("", text) if gone else text
    return (view.translate(_ASCII) if _FOREIGN.search(view) else view), gone


def _redact(text: str, find) -> tuple[str, int]:
    view, gone = _view(text)
    out, at, n = [], 0, 0
    for start, end, new in find(view):
        out += text[at : start + bisect(gone, start)], new
        at, n = end + bisect(gone, end - 1), n + 1
    return "".join(out) + text[at:], n


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _ibans(view: str) -> Iterator[tuple[int, int, str]]:
    for m in _IBAN.finditer(view):
        yield m.start(), m.end(), "SA**…" + re.sub("[^0-9]", "", m[0])[-4:]


def _cards(view: str) -> Iterator[tuple[int, int, str]]:
    """In each chain of digit groups: the run of whole groups with most groups, then leftmost, that is a card number; then from behind it on."""
    for chain in _GROUPS.finditer(view):
        groups = [(m.start() + chain.start(), m.end() + chain.start()) for m in re.finditer("[0-9]+", chain[0])]
        ends = [0]
        for a, b in groups:
            ends.append(ends[-1] + b - a)
        digits = "".join(view[a:b] for a, b in groups)
        windows = [(i, j) for i in range(len(groups)) for j in range(i, min(len(groups), i + 10)) if 13 <= ends[j + 1] - ends[i] <= 19]
        valid = sorted((i - j, i, j) for i, j in windows if luhn(digits[ends[i] : ends[j + 1]]))
        free = 0
        while hit := next(((i, j) for _, i, j in valid if i >= free), None):
            i, j = hit
            yield groups[i][0], groups[j][1], "****" + digits[ends[i] : ends[j + 1]][-4:]
            free = j + 1


def _secrets(view: str) -> Iterator[tuple[int, int, str]]:
    """Runs of digits near a keyword. Only the nearest keyword on either side is looked at: the gap to any other holds that one's."""
    runs = list(_RUN.finditer(view))
    words = [(m.start(), m.end()) for m in _SECRET.finditer(view)] if runs else []
    if not words:
        return
    starts = [start for start, _ in words]
    for run in runs:
        after = bisect(starts, run.start())
        gaps = [(words[after - 1][1], run.start())] if after else []
        if after < len(words):
            gaps.append((run.end(), words[after][0]))
        if any(b - a <= NEAR_CHARS and len(view[a:b].split()) <= NEAR_WORDS for a, b in gaps):
            yield run.start(), run.end(), "[REDACTED]"


def sanitize_text(text: str, patterns: tuple[re.Pattern, ...] = ()) -> tuple[str, bool]:
    """(redacted text, whether a card number was found): account numbers, cards, secrets, then a pack's own patterns.

    A pattern with a group named ``secret`` that matched a text found once in the match loses that
    text only, else the whole match.
    """
    text, _ = _redact(text, _ibans)
    text, cards = _redact(text, _cards)
    text, _ = _redact(text, _secrets)
    for pattern in patterns:

        def swap(m: re.Match) -> str:
            secret = m.groupdict().get("secret")
            return m[0].replace(secret, "[REDACTED]") if secret and m[0].count(secret) == 1 else "[REDACTED]"

        text = pattern.sub(swap, text)
    return text, cards > 0


def suspect(c: Column) -> Column:
    """Whether a text may hold a number or a secret: it has a digit. Anything finer costs Java's regular expressions more than the search itself."""
    return c.rlike(f"[0-9{DIGITS_FROM}]")


def sanitize(c: Column, patterns: tuple[str, ...] = (), bank: Column | None = None, by_bank: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Struct (text, pan_redacted, error). Null in, null out.

    ``by_bank`` has further patterns for the texts of some banks, told by the column ``bank``. A text on
    which redaction fails gives no text, but the kind of error.
    """
    by_bank = by_bank or {}
    bank = F.lit(None).cast("string") if bank is None else bank

    @F.pandas_udf("text string, pan_redacted boolean, error string")
    def redact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = {k: tuple(re.compile(p, re.IGNORECASE) for p in (*patterns, *more)) for k, more in {None: (), **by_bank}.items()}

        def one(text, key):
            if text is None:
                return None, None, None
            try:
                return (*sanitize_text(text, compiled.get(key, compiled[None])), None)
            except Exception as e:  # the message of the error may quote the text
                return None, None, type(e).__name__

        for texts, keys in batches:
            yield pd.DataFrame([one(*x) for x in zip(texts, keys, strict=True)], columns=["text", "pan_redacted", "error"])

    test = suspect(c)
    if by_bank:
        test = test | F.coalesce(bank.isin(*by_bank), F.lit(False))
    if patterns:
        test = c.isNotNull()
    done = redact(F.when(test, c), bank)
    return F.struct(
        F.when(done["error"].isNull(), F.coalesce(done["text"], c)).alias("text"),
        F.when(done["error"].isNull() & c.isNotNull(), F.coalesce(done["pan_redacted"], F.lit(False))).alias("pan_redacted"),
        done["error"].alias("error"),
    )
