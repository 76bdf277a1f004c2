"""Python oracles for the text functions: scanners written from the numbered steps of the contract.

They walk over characters and use no pattern, so that a misread pattern in the library shows.
"""

import hashlib

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"


def without(text, opening, closing, keep_closing):
    """``text`` less everything from ``opening`` to the next ``closing``.

    With ``keep_closing`` that one stays and the end of the text closes too; otherwise an opening that is never closed
    is plain text.
    """
    out, at = [], 0
    while at < len(text):
        start = text.find(opening, at)
        end = text.find(closing, start + len(opening)) if start >= 0 else -1
        if start < 0 or end < 0 and not keep_closing:
            break
        out.append(text[at:start])
        at = len(text) if end < 0 else end if keep_closing else end + len(closing)
    return "".join(out) + text[at:]


def string_end(text, at):
    """Where the literal that opens at ``at`` ends; None if it doesn't. A backslash takes the next character along."""
    at += 1
    while at < len(text) and text[at] != "'":
        at += 2 if text[at] == "\\" else 1
    return at + 1 if at < len(text) else None


def is_word(text, at):
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def digits_end(text, at):
    while at < len(text) and text[at].isdecimal():
        at += 1
    return at


def number_end(text, at):
    """Where the number that begins at ``at`` ends; None if there is none that stands as a word of its own."""
    whole = digits_end(text, at)
    if whole == at or is_word(text, at - 1):
        return None
    ends = [whole]
    if text[whole : whole + 1] == "." and digits_end(text, whole + 1) > whole + 1:
        ends.insert(0, digits_end(text, whole + 1))
    return next((e for e in ends if not is_word(text, e)), None)


def masked(text, end_of):
    out, at = [], 0
    while at < len(text):
        end = end_of(text, at)
        out.append(text[at] if end is None else "?")
        at = at + 1 if end is None else end
    return "".join(out)


def normalize(sql):
    text = without(sql or "", "/*", "*/", keep_closing=False)
    text = without(text, "--", "\n", keep_closing=True).lower()
    text = " ".join(text.split())
    text = masked(text, lambda t, at: string_end(t, at) if t[at] == "'" else None)
    return masked(text, number_end)


def fingerprint(sql):
    bits = int.from_bytes(hashlib.sha256(normalize(sql).encode()).digest())
    return "".join(ALPHABET[bits >> 256 - 5 * (i + 1) & 31] for i in range(16))


def tag_match(sql):
    """What stands between the marker of a leading tag and its end; None without a tag."""
    text = (sql or "").lstrip()
    inside = text[2:].lstrip()
    if not text.startswith("/*") or not inside.startswith("abx"):
        return None
    body, star, rest = inside[3:].partition("*")
    if not star or not rest.startswith("/") or len(body) < 2 or not body[0].isspace():
        return None
    return body


def parse_tag(sql):
    fields = {}
    for token in (tag_match(sql) or "").split():
        cut = token.find("=")
        if cut < 0:
            return None
        fields[token[:cut]] = token[cut + 1 :]
    return None if tag_match(sql) is None else fields
