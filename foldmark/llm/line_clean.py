"""Line-first cleaning: rules judge every line, failing lines go, documents that lose too much go.

A line with words fails when it is
* navigation: one word in NAV_SHARE or more is a bare bar,
* symbols: SYMBOL_SHARE or more symbols a word,
* shouting: of three or more words half end in two exclamation marks, or capital letters outnumber
  small ones two to one (A-Z against a-z),
* boilerplate: it holds one of the phrases of BOILERPLATE (A-Z lower-cased),
* a stub: under STUB_WORDS words and no closing punctuation,
* a repeat of an earlier line of its document.

A document is rejected when it fails the base rules (under 50 words, or over half of them in repeated
three-word windows) or when the failing lines hold more than MOST_LOST percent of its words.

Rows: null text counts as empty; an empty text has no words and fails. Very long texts are judged
whole. Repeated rows are judged alike, ties do not occur. A row without doc_id is judged like any other.
Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa

from .common import raw_texts, tidy

NAV_SHARE, SYMBOL_SHARE, STUB_WORDS, MOST_LOST = 5, 0.34, 4, 40
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
               "uses cookies", "enable javascript", "click here", "lorem ipsum", "subscribe to our newsletter")
# texts are handled as UTF-8 bytes, in which a byte below 128 is always a character of its own
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
CAPITALS, SMALLS = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_PHRASES = [p.encode() for p in BOILERPLATE]
_CLOSED = tuple(c.encode() for c in ".!?:;\"')]}…。！？»”")


def _raw(text):
    return text if isinstance(text, bytes) else text.encode()


def _count(raw, characters):
    return len(raw) - len(raw.translate(None, characters))


def words_of(text):
    return _raw(text).split()


def fails(line, words):
    """Whether a line that has words breaks a rule by itself."""
    line, n = _raw(line), len(words)
    if NAV_SHARE * words.count(b"|") >= n:
        return True
    if _count(line, SYMBOLS) >= SYMBOL_SHARE * n:
        return True
    if n >= 3 and (b"!!" in line and 2 * sum(w.endswith(b"!!") for w in words) >= n
                   or _count(line, CAPITALS) > 2 * _count(line, SMALLS)):
        return True
    if n < STUB_WORDS and not words[-1].endswith(_CLOSED):
        return True
    lower = line.lower()  # of bytes: A-Z only
    return any(p in lower for p in _PHRASES)


def repeated_words(words):
    """Words in three-word windows found twice or more in the text."""
    if len(words) < 4:
        return 0
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    pair = x[:-1] * len(ids) + x[1:]
    if len(ids) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(ids) + x[2:]
    ordered = np.sort(window)
    more = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(more):
        return 0
    again = np.isin(window, more)
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k:len(again) + k] |= again
    return int(cover.sum())


def judged(raw):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost words, cleaned text) of a text in UTF-8."""
    words, kept, earlier, copies, lost = [], [], set(), 0, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            words += own
            again = line in earlier
            earlier.add(line)
            copies += again
            if again or fails(line, own):
                lost += len(own)
                continue
        kept.append(line)
    chars = len(raw.translate(None, SPACES + _FOLLOWING))
    return (len(words), chars, _count(raw, SYMBOLS), copies, repeated_words(words), lost, b"\n".join(kept))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


def clean(docs, with_text=True):
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept and (unless switched off) the cleaned text."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [judged(t) for t in raw_texts(part.column(1))]
                out = [part.column(0)]
                out += [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
                if with_text:
                    out.append(pa.array([r[6] for r in rows], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", *COUNTS] + ["cleaned"] * with_text
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", cleaned string" * with_text
    base = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    return (docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
            .selectExpr("*", f"({base}) AS base_failed",
                        f"NOT ({base}) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept"))


ORACLE = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spans AS (SELECT doc_id, i, words[i:i+2] AS win FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM cut WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM spans) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, k, all_lines[k] AS line, regexp_extract_all(all_lines[k], '[^\x20\x09-\x0D]+') AS words FROM (
    SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS k
    FROM (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM cut))),
ranked AS (SELECT *, len(words) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    len(regexp_extract_all(line, '[A-Z]')) AS capitals, len(regexp_extract_all(line, '[a-z]')) AS smalls
  FROM lines WHERE len(words) > 0),
judged AS (SELECT doc_id, n, again, again
    OR 5 * len(list_filter(words, lambda w: w = '|')) >= n
    OR symbols >= 0.34::DOUBLE * n
    OR (n >= 3 AND (2 * len(list_filter(words, lambda w: w LIKE '%!!')) >= n OR capitals > 2 * smalls))
    OR (n < 4 AND NOT regexp_matches(words[n], '[.!?:;"'')\]}…。！？»”]$'))
    OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      'all rights reserved|privacy policy|terms of use|terms of service|cookie policy|uses cookies|enable javascript|click here|lorem ipsum|subscribe to our newsletter')
    AS failed FROM ranked),
lost AS (SELECT doc_id, CAST(sum(CASE WHEN failed THEN n ELSE 0 END) AS BIGINT) AS lost_words,
    CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) AS BIGINT) AS n_dup_lines FROM judged GROUP BY doc_id),
counted AS (SELECT c.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lost_words, 0) AS lost_words
  FROM cut c LEFT JOIN lost l USING (doc_id) LEFT JOIN covered v ON v.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 40 * n_words AS kept
FROM counted
"""
