"""How a commit text ends: what the last hunk, sentence or word still owes."""

from __future__ import annotations

import re

HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", re.M)
_DOTS = re.compile(r"[ \t]*(?:\.\.\.|…|\[\.\.\.\])\s*\Z")
_STOP = re.compile(r"[.!?。！？:;][\"'»“”)\]`*_]*\Z")
_TRAILER = re.compile(r"(?:[A-Z][\w-]*-(?:by|to|id): *\S.*|(?:Cc|Bug|Issue|Link|Refs?|See|Fixes|Closes|Resolves)\b:? +(?:#|\w+[-/#]\d|https?:).*)\Z", re.I)
_HEADER = re.compile(r"(?:commit [0-9a-f]{40}|From [0-9a-f]{40}\b.*|Author:.*|From:.*|Date:.*|Subject:.*|Merge:.*|AuthorDate:.*|Commit:.*)\Z")
_SIGNATURE = re.compile(r"^-- ?\n\d+(?:\.\d+)*(?:\.?[\w.]+)?\s*\Z", re.M)
_PATHLIKE = re.compile(r"(?:#?\s*)?\S*[/\\]\S+\Z|#?\s*\S+\.\w{1,4}\Z")
_HASH = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}[\])]?\Z")
_EMAIL = re.compile(r"<[^<>]*\Z")
_WORDS = re.compile(r"[^\W\d_]{2,}")

COMPLETE, SENTENCE, HUNK_SHORT, WORD, OPEN = "complete", "sentence", "hunk", "word", "open"


def owed(lines: list[str], old: int, new: int) -> tuple[int, int, int]:
    """Lines of a hunk still missing on either side, and the index after the last line that belongs to it."""
    for k, line in enumerate(lines):
        if old <= 0 and new <= 0:
            return 0, 0, k
        c = line[:1]
        if c == "+":
            new -= 1
        elif c == "-":
            old -= 1
        elif c != "\\":
            old, new = old - 1, new - 1
    return max(old, 0), max(new, 0), len(lines)


def _prose(line: str) -> bool:
    """A line of running text rather than code, a heading or a list entry."""
    s = line.strip()
    return len(_WORDS.findall(s)) >= 4 and not re.search(r"[=_{}()\[\];<>#*]|\w\.\w|//|->|::|\":", s) and len(_WORDS.findall(s)) * 2 >= len(s.split())


def _binary(lines: list[str]) -> str:
    """Ending inside a git binary patch: each line's first letter says how many bytes it holds."""
    last = next((x for x in reversed(lines) if x.strip()), "")
    if re.match(r"(?:literal|delta) \d+\Z", last) or not re.match(r"[A-Za-z]\S", last):
        return HUNK_SHORT if re.match(r"(?:literal|delta) \d+\Z|GIT binary", last) else COMPLETE
    n = ord(last[0]) - (64 if last[0] < "a" else 70)
    return COMPLETE if len(last) - 1 >= -(-n // 4) * 5 else WORD


def message_part(text: str) -> tuple[str, bool]:
    """The message of a commit text without its header, and whether a header stood there whose message is missing."""
    if re.match(r"(?:commit [0-9a-f]{7,40}\b|From [0-9a-f]{7,40}\b)", text):
        head, gap, body = text.partition("\n\n")
        subject = re.search(r"^Subject: *(.*(?:\n[ \t].*)*)", head, re.M)
        if subject:
            return subject[1] + ("\n\n" + body if gap else ""), False
        return (body, False) if gap and body.strip() else ("", True)
    return text, False


def _message(text: str, dots: bool) -> str:
    body, headless = message_part(text)
    if headless:
        return WORD
    body = re.split(r"^---\s*$", body, maxsplit=1, flags=re.M)[0]
    paragraphs = [p for p in re.split(r"\n[ \t]*\n", body.strip("\n")) if p.strip()]
    if not paragraphs:
        return COMPLETE
    lines = [x.strip() for x in paragraphs[-1].split("\n") if x.strip()]
    last = lines[-1]
    if _EMAIL.search(last) or re.search(r"(?:^|\s)'[^'\s]*\Z", last):
        return WORD
    if re.match(r"Change-Id:", last):
        return COMPLETE  # a hash, however long, is an ending
    if _TRAILER.match(last) and not (len(lines) > 1 and _prose(lines[-2]) and not _STOP.search(lines[-2])):
        return COMPLETE
    if _STOP.search(last) and not dots:
        return COMPLETE
    if _PATHLIKE.match(last) or _HASH.search(last):
        return COMPLETE
    if re.match(r"(?:#|[-*•] |\d+[.)] )", last) and len(lines) > 1 and not dots:
        return COMPLETE
    if len(paragraphs) == 1 or len(paragraphs) == 2 and paragraphs[0].strip().startswith("Merge "):
        return COMPLETE if len(lines) == 1 else (SENTENCE if _prose(last) or dots else OPEN)
    if re.match(r"(?:[\w-]+: |#|[\w-]+:\Z)", last) and len(lines) == 1:
        return OPEN
    return SENTENCE


def last_word(text: str) -> str | None:
    """The word that the text ends in, in lower case, if it ends in a letter (an ellipsis after it aside)."""
    bare = _DOTS.sub("", text[-120:])
    if bare != text[-120:] and "\n@@ " not in text:
        return None  # dots after a message that stops nowhere are its own
    m = re.search(r"(?<![^\W_])[^\W\d_]+\Z", bare)
    return m[0].lower() if m else None


def tail(text: str | None) -> str:
    """What stands last: newline, stop, letter, digit, dots or other."""
    if not text:
        return "other"
    if text.endswith(("\n", "\r")):
        return "newline"
    if _DOTS.search(text[-8:]):
        return "dots"
    if _STOP.search(text[-8:]):
        return "stop"
    return "letter" if text[-1].isalpha() else "digit" if text[-1].isdigit() else "other"


def ending(text: str | None) -> str:
    """complete, sentence (ends inside one), hunk (lines owed), word (ends inside one) or open (can't be told)."""
    if text is None or not text.strip():
        return COMPLETE
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    bare = _DOTS.sub("", t)
    dots = bare != t
    if dots:
        t = bare
    start = t.find("diff --git ")
    start = start if start == 0 or start > 0 and t[start - 1] == "\n" else (m.start() + 1 if (m := re.search(r"\ndiff --git ", t)) else -1)
    last = None
    for last in HUNK.finditer(t, max(start, 0)):
        pass
    if start < 0 and last is None:
        if _SIGNATURE.search(t):
            return COMPLETE
        return _message(t, dots)
    tail = t[last.end() :] if last else t[start:]
    if last:
        lines = tail.split("\n")[1:]
        ended = bool(lines) and lines[-1] == ""
        body = lines[:-1] if ended else lines
        if "\n" not in tail:
            return HUNK_SHORT
        o, n, k = owed(body, int(last[1] or 1) if last[1] != "0" else 0, int(last[2] or 1) if last[2] != "0" else 0)
        if o or n:
            return HUNK_SHORT
        rest = [x for x in body[k:] if not x.startswith("\\")]
        if not any(x.strip() for x in rest):
            if ended and not dots:
                return COMPLETE
            line = body[-1] if body else ""
            if line.startswith("\\"):
                return COMPLETE if line.startswith("\\ No newline at end of file") else WORD
            if _prose(line[1:]):
                return COMPLETE if _STOP.search(line.rstrip()) and not dots else SENTENCE
            return OPEN if not dots else WORD
    else:
        rest = tail.split("\n")
    head = max((i for i, x in enumerate(rest) if x.startswith("diff --git ")), default=-1)
    after = "\n".join(rest)
    if _SIGNATURE.search(after):
        return COMPLETE
    if head < 0:
        if any(x.strip() for x in rest) and last:
            loose = [x for x in rest if x.strip()]
            if all(x[:1] in " +-" for x in rest if x):  # more lines than announced
                return COMPLETE if t.endswith("\n") and not dots else OPEN
            if loose[0].strip() in ("--", "-- ") or loose[0].startswith("-- "):
                return COMPLETE
            return _message("\n".join(["t", "", *rest]), dots)
        return COMPLETE
    section = rest[head:]
    if any(x.startswith("GIT binary patch") for x in section):
        return _binary(section)
    final = next((x for x in reversed(section) if x.strip()), "")
    if final.startswith("Binary files "):
        return COMPLETE if final.endswith(" differ") else WORD
    if re.match(r"(?:rename to|copy to|new mode|old mode|similarity index|rename from|deleted file mode|new file mode) ", final) and not final.startswith(("old mode", "similarity", "rename from")):
        return COMPLETE if t.endswith("\n") else OPEN
    return HUNK_SHORT
