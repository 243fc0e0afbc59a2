"""The own prose of a forum post: without quotes, code, signatures, links and markup, as sentences of numbered words."""

from __future__ import annotations

import html
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import regex

QUOTE = regex.compile(r"\[(/?)quote[^\]\n]{0,60}\]|<(/?)blockquote[^>\n]{0,60}>", regex.I)
CODE = regex.compile(r"(?:\[code\]|```).*?(?:\[/code\]|```|\Z)", regex.I | regex.S)
WROTE = regex.compile(r"^(?:On|Am|Le|El) \d{4}-\d\d-\d\d.{0,60}(?:wrote|schrieb|écrit|escribió).{0,40}$", regex.M)
SIGNATURE = regex.compile(r"^(?:-- ?|\*{3}|_{10})$|<hr ?/?>|\[size=1\]", regex.M | regex.I)
BREAK = regex.compile(r"<(?:br|rb|p|/p)[^>\n]{0,4}>", regex.I)
LINK = regex.compile(r"\[url=[^\]\n]*\][^\n]*?(?:\[/url\]|$)|\[img\][^\n]*?(?:\[/img\]|$)|https?://\S+", regex.I | regex.M)
TAG = regex.compile(r"</?[a-z]{1,10}[^>\n]{0,20}>|\[/?[a-z]{1,8}(?:=[^\]\n]{0,40})?\]", regex.I)
# within a run of text without white space: where a sentence ends, and whether one ends with the run
INNER_END = regex.compile(r"(?<=[.!?])(?=\p{Lu})|(?<=[。！？])")
END = regex.compile(r"(?:[.!?…][\"')\]]*|[。！？])\Z")
WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)?|\d+")
LONG, USUAL = 28, 13
SENTENCE_END, POST_END = -1, -2


def _kind(tag: str) -> str:
    return "q" if tag[0] == "[" else "b"


def _without_quoted_lines(text: str) -> str:
    """Lines that start with ``>`` go; closing tags in them whose opening tag is elsewhere stay."""
    out = []
    for line in text.split("\n"):
        if not line.lstrip().startswith((">", "&gt;")):
            out.append(line)
            continue
        opened, kept = [], []
        for m in QUOTE.finditer(line):
            kind = _kind(m[0])
            if not (m[1] or m[2]):
                opened.append(kind)
            elif kind in opened:
                while opened.pop() != kind:
                    pass
            else:
                kept.append(m[0])
        out.append(" ".join(kept))
    return "\n".join(out)


def _without_quotes(text: str) -> str:
    """Quotes go, nested ones too. A quote that was cut short may lack closing tags: then the last one closes them all,
    and without any the quote ends with the first long line that ends within a sentence, else with its first line."""
    out, opened, at, last = [], [], 0, None
    for m in QUOTE.finditer(text):
        if not opened:
            out.append(text[at : m.start()])
        at, kind = m.end(), _kind(m[0])
        if not (m[1] or m[2]):
            opened.append(kind)
        else:
            last = at
            if kind in opened:
                while opened.pop() != kind:
                    pass
    if not opened:
        out.append(text[at:])
    elif last is not None:
        out.append(text[last:])
    else:
        lines = text[at:].split("\n")
        cut = next((i for i, line in enumerate(lines) if len(line) >= 60 and not regex.search(r"[.!?)>\]]\s*$", line)), 0)
        out.append("\n".join(lines[cut + 1 :]))
    return "\n".join(out)


def own_prose(text: str) -> str:
    """What the author wrote, as plain text; an empty string if nothing is left."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if ">" in text or "&gt;" in text:
        text = _without_quoted_lines(text)
    if "[" in text or "<" in text:
        text = _without_quotes(text)
    if "[" in text or "```" in text:
        text = CODE.sub("\n", text)
    text = WROTE.sub("\n", text)
    signed = SIGNATURE.search(text)
    if signed:
        text = text[: signed.start()]
    if "[" in text or "http" in text.lower():
        text = LINK.sub(" ", text)
    if "<" in text or "[" in text:
        text = TAG.sub(" ", BREAK.sub("\n", text))
    return html.unescape(text) if "&" in text else text


class _Runs(dict):
    """For each run of text without white space its words' numbers, and SENTENCE_END where a sentence ends; met once, then kept."""

    def __init__(self, words: dict[str, int], most: int) -> None:
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, run: str) -> tuple[int, ...]:
        if run == "\n":
            codes: tuple[int, ...] = (SENTENCE_END,)
        elif len(pieces := run.split()) != 1 or pieces[0] != run:
            codes = tuple(chain.from_iterable(self[p] for p in pieces))  # white space of other kinds
        else:
            found: list[int] = []
            for i, part in enumerate(INNER_END.split(run)):
                found += [SENTENCE_END] * (i > 0)
                found += [0 if w[0].isdigit() else self.words.setdefault(w, len(self.words)) for w in WORD.findall(part.lower())]
            codes = (*found, SENTENCE_END) if END.search(run) else tuple(found)
        if len(self) >= self.most:
            self.clear()
        self[run] = codes
        return codes


@dataclass(frozen=True)
class Sentences:
    """Words of all sentences one after the other (0 is any number), where each sentence starts (and the last ends), and the post of each."""

    words: np.ndarray
    starts: np.ndarray
    post: np.ndarray


class Reader:
    """Splits texts into sentences of words. A word keeps its number, its place in ``names``, for as long as the reader lives."""

    def __init__(self, most_runs: int = 400_000) -> None:
        self.words = {"0": 0}
        self._runs = _Runs(self.words, most_runs)

    @property
    def names(self) -> list[str]:
        return list(self.words)

    def read(self, texts: Iterable[str]) -> Sentences:
        """The sentences of each text in lower case; those of numbers alone are left out.

        Text without sentence marks comes in pieces of about the usual length.
        """
        runs = self._runs
        each = (chain(chain.from_iterable(map(runs.__getitem__, t.replace("\n", " \n ").split(" "))), (POST_END,)) for t in texts)
        codes = np.fromiter(chain.from_iterable(each), np.int64)
        word = codes >= 0
        run = np.cumsum(~word)[word]  # the stretch between two ends that a word is in
        words = codes[word]
        n = np.bincount(run, minlength=0)
        first = np.cumsum(n) - n
        kept = np.flatnonzero(np.bincount(run, words > 0, len(n)) > 0) if len(n) else np.zeros(0, np.int64)
        length = n[kept]
        parts = np.where(length <= LONG, 1, np.round(length / USUAL).astype(np.int64))
        which = np.repeat(np.arange(len(kept)), parts)
        part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[kept][which] + length[which] * part // parts[which]
        size = first[kept][which] + length[which] * (part + 1) // parts[which] - begin
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(starts[-1]) + np.repeat(begin - starts[:-1], size)
        ends_before = np.cumsum(codes == POST_END)[~word] if len(codes) else np.zeros(0, np.int64)
        post = np.concatenate([[0], ends_before])[kept[which]]
        return Sentences(words[at], starts, post)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of one text."""
    reader = Reader()
    found = reader.read([text])
    names = reader.names
    return [[names[w] for w in found.words[a:b]] for a, b in zip(found.starts[:-1], found.starts[1:])]
