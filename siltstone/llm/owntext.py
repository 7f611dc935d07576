"""The own text of a forum post: what is left without quotes, attributions, signature, sign-off and markup."""

from __future__ import annotations

import html
import unicodedata

import regex

_BREAK = regex.compile(r"<br\s*/?>|\r\n?", regex.I)
#: Format characters (soft hyphen, zero-width, direction marks), variation selectors and the object replacement mark.
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}&&[\p{Cf}︀-️]]|￼|[\x00-\x08\x0E-\x1F\x7F]", regex.V1)
_LINE_SEPARATORS = regex.compile(r"[  \x0B\x0C\x85]")
#: The same for plain ASCII: what cannot be seen goes, other line separators become blanks.
_ASCII = {c: None for c in [*range(9), *range(14, 32), 127]} | {11: " ", 12: " "}
_NESTED = regex.compile(r"\[quote(?:=[^\[\]\n]*)?\]|\[/quote\]|<blockquote\b[^<>]*>|</blockquote\s*>", regex.I)
_QUOTED = regex.compile(r"^[ \t]*(?:>|\||»|&gt;)")
_WHO = r"\S+"
_WHEN = r"[\d./:-]+(?:[ T][\d:]+)?"
#: Fixed forms of attribution lines in the four languages of the corpus.
_ATTRIBUTION = regex.compile(
    rf"^\s*(?:@{_WHO} said|(?:Quote from|Zitat von|Cita de|Citation de) {_WHO}\s?:"
    rf"|On {_WHEN}, {_WHO} wrote\s?:|{_WHO} wrote on {_WHEN}\s?:"
    rf"|Am {_WHEN} schrieb {_WHO}\s?:|{_WHO} schrieb am {_WHEN}\s?:"
    rf"|El {_WHEN}, {_WHO} escribió\s?:|{_WHO} escribió el {_WHEN}\s?:"
    rf"|Le {_WHEN}, {_WHO} a écrit\s?:|{_WHO} a écrit le {_WHEN}\s?:)\s*$",
    regex.I,
)
_SIGNATURE = regex.compile(r"^\s*(?:--\s*|~{3,}\s*|_{3,}\s*|<hr\s*/?>.*|\[sig\].*)$", regex.I)
_CLIENT = regex.compile(r"^\s*(?:Sent from my .{1,40}|Typed on an? .{1,40}tablet, excuse typos)\s*$")
_SIGN_OFF = regex.compile(r"^\s*(?:Cheers|Best|Regards|Best regards|Kind regards|Thanks|Gruß|Grüße|Viele Grüße|Saludos|Un saludo|Cordialement|Amicalement),?\s+(?:[\p{Ll}][\w-]*|[\w-]*\d)\s*$")
#: Tags and bracket tags of any length, up to their closing mark; an opening mark in between begins anew, so this is linear.
_TAGS = regex.compile(r"</?[a-zA-Z][^<>]*>|\[/?(?:i|b|u|s|url|img|code|sig|quote|size|color)(?:=[^\[\]]*)?\]", regex.I)
_ENTITY = regex.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|[a-zA-Z][a-zA-Z0-9]+);")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SENTENCE = regex.compile(r"(?<=[.!?])[\"'”’)\]*]*\s+(?=[\p{Lu}¿¡\"“«*\d])|\n+")


def _without_nested_quotes(text: str) -> str:
    """Drops nested quote elements. One that is never closed ends at the first line break of its own text."""
    out, depth, start, last = [], 0, 0, 0
    for m in _NESTED.finditer(text):
        opening = m[0][1] != "/"
        if opening:
            if not depth:
                out.append(text[start : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append("\n")
                start = m.end()
        else:  # closes nothing
            out += [text[start : m.start()], "\n"]
            start = m.end()
        last = m.end()
    if depth:
        rest = text[last:].lstrip("\n")
        return "".join(out) + "\n" + (rest.partition("\n")[2])
    return "".join([*out, text[start:]])


def _without_tags(text: str) -> str:
    """Drops tags and comments; a comment that is not closed stays."""
    if "<!--" in text:
        out, at = [], 0
        while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
            out.append(text[at:start])
            at = end + 3
        text = "".join([*out, text[at:]])
    return _TAGS.sub("", text) if "<" in text or "[" in text else text


def _character(m: regex.Match) -> str:
    """What an entity stands for; numbers beyond Unicode give the replacement character."""
    digits = (m[1] or m[2] or "").lstrip("0")
    return "\ufffd" if len(digits) > 7 else html.unescape(m[0]).replace("\xa0", " ")


def own_text(text: str | None, author: str | None = None) -> str:
    """Own text of a post, line structure kept; '' for null.

    Removed are quotes by prefix (``>``, ``|``), by ``[quote]`` and ``<blockquote>`` (nested, not always closed), attribution
    lines, everything from a signature separator on, a closing sign-off line, tags and entities. Characters that cannot
    be seen are removed as if absent. Linear in the text's length.
    """
    if not text:
        return ""
    t = _BREAK.sub("\n", text) if "\r" in text or "<" in text else text
    if t.isascii():
        t = t.translate(_ASCII)
    else:
        t = _LINE_SEPARATORS.sub(" ", t)
        t = _UNSEEN.sub("", t)
    if "[" in t or "<" in t:
        t = _without_nested_quotes(t)
    kept = []
    for line in t.split("\n"):
        bare = line.strip()
        if bare:  # each pattern only where its first or last characters allow it
            if (bare[0] in ">|»&" and _QUOTED.match(line)) or ((bare[-1] == ":" or bare[-4:].lower() == "said") and _ATTRIBUTION.match(line)):
                continue
            if bare[0] in "-~_<[" and _SIGNATURE.match(line):
                break
            cut = line.find("[sig]")
            if cut >= 0:
                kept.append(line[:cut])
                break
            if bare[0] in "ST" and _CLIENT.match(line):
                continue
        kept.append(line)
    while kept and not kept[-1].strip():
        kept.pop()
    if kept:
        end = _without_tags(kept[-1]).strip()
        words = end.rsplit(None, 1)
        by_author = author and len(words) == 2 and words[1] == author and len(words[0]) <= 30 and words[0].endswith(",")
        if by_author or _SIGN_OFF.match(end):
            kept.pop()
    t = _without_tags("\n".join(kept))
    if "&" in t:
        t = _ENTITY.sub(_character, t)
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def words_of(own: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(own.lower())


def own_words(text: str | None, author: str | None = None) -> list[str]:
    return words_of(own_text(text, author))


def sentences_of(own: str) -> list[str]:
    """Sentences of an own text: cut after . ! ? before a capital, a digit or an opening mark, and at blank lines.

    Single line breaks within a wrapped sentence do not cut it.
    """
    out = []
    for para in regex.split(r"\n\s*\n", own):
        flat = " ".join(para.split())
        out += [s for s in _SENTENCE.split(flat) if s and s.strip()]
    return out
