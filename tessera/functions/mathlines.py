"""Mathematics on one line of text: signs, words and brackets are read as tokens, and blanks follow from their kinds."""

from __future__ import annotations

import html
import itertools
import re
from dataclasses import dataclass

# Characters and their raised or lowered forms.
PLAIN = "0123456789+-=()n"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"
LOWERED = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₙ"
OPERATORS = {"*": "×", "−": "-", "–": "-", "—": "-"}
# Numbers, parts and signs in words.
NUMERATORS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
PARTS = {"half": "2", "halves": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}
SPOKEN = {
    "less than or equal to": "≤", "greater than or equal to": "≥", "not equal to": "≠", "cross times": "×", "multiplied by": "×", "divided by": "÷",
    "open parentheses": "(", "close parentheses": ")", "open parenthesis": "(", "close parenthesis": ")", "left parenthesis": "(", "right parenthesis": ")",
    "open bracket": "[", "close bracket": "]", "open braces": "{", "close braces": "}", "plus or minus": "±", "minus or plus": "∓",
    "plus": "+", "minus": "-", "equals": "=", "times": "×",
}

SIGNS, OPEN, CLOSED, STOPS = set("=+-×÷≤≥≠±∓"), set("([{"), set(")]}"), set(",.;:!?")
_TOKEN = re.compile(r"(\s*)(\w+|\S)")
_PHRASES = {tuple(k.split()): v for k, v in SPOKEN.items()}
_LONGEST = max(map(len, _PHRASES))
_SCRIPTS = {"raised": str.maketrans(PLAIN, RAISED), "lowered": str.maketrans(PLAIN, LOWERED)}


@dataclass
class Token:
    text: str
    gap: bool = False  # a blank before it
    call: bool = False  # a bracket that belongs to the name before it


def tokens(text: str) -> list[Token]:
    return [Token(m[2], bool(m[1])) for m in _TOKEN.finditer(html.unescape(text or ""))]


def laid_out(line: list[Token]) -> str:
    """None before a stop or inside brackets, one around a sign, none at a sign of a number, else as it was."""
    out, before, is_sign_of = "", "", False
    for i, token in enumerate(line):
        t, after = token.text, line[i + 1].text if i + 1 < len(line) else ""
        alone = t == "-" and (before == "" or before in SIGNS or before in "([") and bool(re.match(r"[A-Za-z0-9.]", after))
        if not out or alone or is_sign_of or token.call or t in STOPS or t in CLOSED or before in OPEN:
            glue = ""
        elif t in SIGNS or before in SIGNS:
            glue = " "
        else:
            glue = " " if token.gap else ""
        out, before, is_sign_of = out + glue + t, t, alone
    return out


def inline(text: str | None) -> str:
    return laid_out(tokens(text or ""))


def operator(text: str | None) -> str:
    """One sign for each operator."""
    cleaned = inline(text)
    return OPERATORS.get(cleaned, cleaned)


def script(text: str, form: str) -> str | None:
    """Raised or lowered characters; null where some character has none."""
    return text.translate(_SCRIPTS[form]) if text and all(c in PLAIN or not c.isascii() for c in text) else None


def bracketed(text: str) -> str:
    """In parentheses unless it is one word or has them."""
    text = text.strip()
    bare = not text or re.fullmatch(r"[A-Za-z0-9_.]+", text) or text[0] + text[-1] == "()"
    return text if bare else f"({text})"


def power(base: str, exponent: str) -> str:
    return base + (script(exponent, "raised") or f"^{bracketed(exponent)}")


def _said(line: list[Token], at: int, phrase: str) -> bool:
    words = phrase.split()
    return [t.text.lower() for t in line[at : at + len(words)]] == words


def _fractions(line: list[Token]) -> list[Token]:
    """`fraction numerator a over denominator b end fraction` as one token, however deep; what is not closed stays as words."""
    frames: list[tuple[list[Token], list[Token]]] = [([], [])]  # the words that opened each, and what it holds
    at = 0
    while at < len(line):
        if _said(line, at, "fraction numerator"):
            frames.append((line[at : at + 2], []))
            at += 2
        elif len(frames) > 1 and _said(line, at, "end fraction"):
            opening, held = frames.pop()
            middle = next((i for i in range(len(held)) if _said(held, i, "over denominator")), None)
            if middle is None:
                frames[-1][1].extend(opening + held + line[at : at + 2])
            else:
                above, below = (bracketed(laid_out(_read(x))) for x in (held[:middle], held[middle + 2 :]))
                frames[-1][1].append(Token(f"{above}/{below}", opening[0].gap))
            at += 2
        else:
            frames[-1][1].append(line[at])
            at += 1
    return [t for opening, held in frames for t in opening + held]


def _signs(line: list[Token]) -> list[Token]:
    out, at = [], 0
    while at < len(line):
        words = [t.text.lower() for t in line[at : at + _LONGEST]]
        n = next((n for n in range(len(words), 0, -1) if tuple(words[:n]) in _PHRASES), 0)
        out.append(Token(_PHRASES[tuple(words[:n])], line[at].gap) if n else line[at])
        at += n or 1
    return out


def _ends_a_term(line: list[Token]) -> bool:
    return bool(line) and bool(re.search(r"[A-Za-z0-9)\]]$", line[-1].text))


def _read(line: list[Token]) -> list[Token]:
    """Spoken mathematics as signs: fractions, operators, parts of a whole, powers, negatives, factors and calls."""
    line, out, at = _signs(_fractions(line)), [], 0
    while at < len(line):
        token, word = line[at], line[at].text.lower()
        following = line[at + 1].text if at + 1 < len(line) else ""
        part = following.lower() if following.lower() in PARTS else following.lower().removesuffix("s")
        if word == "negative" and re.match(r"[A-Za-z0-9.]", following):
            out += [Token("-", token.gap), Token(following)]
            at += 2
        elif _said(line, at, "end exponent"):
            at += 2
        elif (word in NUMERATORS or word.isdigit()) and part in PARTS:
            out.append(Token(f"{NUMERATORS.get(word, word)}/{PARTS[part]}", token.gap))
            at += 2
        elif _said(line, at, "to the power of") and _ends_a_term(out) and at + 4 < len(line):
            minus = line[at + 4].text == "-" and at + 5 < len(line)
            exponent = ("-" if minus else "") + line[at + 4 + minus].text
            if re.fullmatch(r"-?[A-Za-z0-9]+", exponent):
                out[-1] = Token(power(out[-1].text, exponent), out[-1].gap)
                at += 5 + minus
            else:
                out.append(token)
                at += 1
        elif word in ("squared", "cubed") and _ends_a_term(out):
            out[-1] = Token(out[-1].text + ("²" if word == "squared" else "³"), out[-1].gap)
            at += 1
        else:
            out.append(token)
            at += 1
    for at, (before, token) in enumerate(zip(out, out[1:], strict=False), 1):
        if before.text[-1:].isdigit() and re.fullmatch(r"[A-Za-z]", token.text):
            token.gap = False  # a factor
        token.call |= token.text == "(" and bool(re.fullmatch(r"[A-Za-z]{1,4}", before.text)) and _is_argument(out[at + 1 :])
    return out


def _is_argument(line: list[Token]) -> bool:
    """Whether words, numbers and signs alone stand before the closing bracket."""
    inside = list(itertools.takewhile(lambda t: re.fullmatch(r"[A-Za-z0-9]+|[-+*/=]", t.text), line))
    return 0 < len(inside) < len(line) and line[len(inside)].text == ")"


def spoken(text: str | None) -> str:
    return laid_out(_read(tokens(text or "")))
