"""Per-page statistics that problems 1, 5 and 6 share: one Python stage over the main bodies."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .body import Bodies
from .common import LINK, cut, table

BLOCK = 1024

URL = re.compile(r"(?:https?://|www\.)[^\s<>)\]]+")
TOKEN = re.compile(r"[^\W_]+")
HEAD = re.compile(r"\s*#{1,6}\s")
LEAD = re.compile(r"^\s*(?:>\s*)*(?:[-*•+]\s+|\d{1,3}[.)]\s+)?")
BULLET = re.compile(r"^\s*(?:>\s*)*(?:[-*•+]\s+|\d{1,3}[.)]\s+)")
#: The end of a sentence: a mark and a blank or the line's end, or a full-width mark.
END = re.compile(r"(?<![0-9\s])\s?[.!?…]+[\"'”’»)*_]*(?=\s|$)|(?<=[0-9])[.!?…]+[\"'”’»)*_]*(?=\s+[^\W\d]|$)|[。！？｡]")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
KANA = re.compile(r"[\u3040-\u30ff]")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"’“”„«»()\-–—。、，！？…·]")
CODE = re.compile(r"[{}()\[\]<>;=\\&@~^$]")
STOP = re.compile(r"[.!?…。！？][\"'”’»)*_]*$")
PARTS = re.compile(r"[\n,;|•]| / ")
TAGS = re.compile(r"(?<!\S)#\w")
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
WIDE_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]{2,}")
ADDRESS = re.compile(r"^\w+://[^/]*")
PARTING = re.compile(r"(?<=[.!?…。！？])\s+")

#: Forms of unfilled placeholders.
HOLDER = re.compile(
    r"\{\{\s*[A-Za-z][\w. ]*\}\}|[$#]\{\s*[A-Za-z][\w. ]*\}|\$\([A-Za-z][\w.]*\)|\{%[-\s]*[A-Za-z][\w .]*%\}|<%=?\s*[A-Za-z][\w. ]*%>"
    r"|\[\[\s*[A-Za-z][\w. ]*\]\]|%%[A-Za-z][\w.]*%%|(?<![\w%])%[A-Za-z][A-Za-z_.]{2,}%(?!\w)|\*\|[A-Za-z][\w:.]*\|\*"
    r"|(?<!\w)__[A-Za-z]\w*?__(?!\w)|@@[A-Za-z]\w*@@|(?i:\[(?:insert|your|enter|add)\s[^\]\n]{1,60}\](?!\())"
    r"|(?i:<[a-z_ ]{1,60}\bhere>)|\bTODO:|\bTBD\b|\bFIXME\b|(?<![\w{$#])\{[A-Za-z][A-Za-z_.]+\}(?!\w)"
)
HINTS = ("{", "%", "[[", "<", "*|", "__", "@@", "TODO", "TBD", "FIXME", "$(", "[I", "[i", "[Y", "[y", "[E", "[e", "[A", "[a")
#: Words of filler texts and of messages of servers, shields and script loaders.  Sentences that many
#: different pages answer with are found by that evidence, so only words common to such texts stand here.
FILLER = re.compile(
    r"(?i)^\W*lorem ipsum dolor|\b(?:sample|dummy|demo|placeholder) (?:text|content)\b|\byour (?:headline|text|title) here\b|\bblindtext\b"
    r"|texte d.exemple|texto de (?:ejemplo|muestra|exemplo)|\bпример текста\b|\bprzykładowy tekst\b"
)
LATIN_FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum ut et ea ex".split())
NOTICE = re.compile(
    r"(?i)\b(?:java ?scripts?|scripts?|skripte|scripty|скрипты?)\b|スクリプト|脚本"
    r"|\b(?:40[0134]|410|429|50[0234])\b.{0,40}(?:error|find|found|server|busy|page|forbidden|gateway|internal)"
    r"|\bnot found\b|\bnicht gefunden\b|\bintrouvable\b|\bno encontrada\b|\bnão encontrada\b|не найдена|nie znaleziono"
    r"|\b(?:internal|fatal|server) error\b|\berreur (?:interne|serveur)\b|\berror (?:interno|del servidor)\b|\bfehler \d|\bbad (?:request|gateway)\b"
    r"|^\W*warning: \S+\(\)|traceback \(most recent|\baccess (?:is |was )?denied\b|\bforbidden\b|\bcaptcha\b"
)


#: Without one of these no text matches FILLER or NOTICE.
NOTE_HINTS = (
    "lorem", "sample", "dummy", "demo", "placeholder", "your", "blindtext", "texte", "texto", "текста", "tekst", "script", "skript", "скрипт", "スクリプト", "脚本",
    "40", "41", "42", "50", "found", "gefunden", "introuvable", "encontrada", "найден", "znaleziono", "error", "erreur", "fehler", "bad", "warning", "traceback",
    "denied", "forbidden", "captcha",
)


def language(count: Counter, text: str, common: dict[str, tuple[str, ...]]) -> tuple[str, float]:
    """(language, share of its common words); ja and zh by script, '' where nothing tells."""
    if not count:
        return "", 0.0
    total = sum(count.values())
    if not text.isascii():
        wide = len(WIDE.findall(text))
        if wide > total:
            return ("ja" if len(KANA.findall(text)) * 10 > wide else "zh"), 0.0
    hits: Counter[str] = Counter()
    for w in count.keys() & common.keys():
        for lang in common[w]:
            hits[lang] += count[w]
    if not hits:
        return "", 0.0
    lang, n = min(hits.items(), key=lambda x: (-x[1], x[0]))
    return lang, n / total


def sentences(line: str) -> tuple[int, int, int]:
    """(sentences, characters in sentences, other characters) of a line without its list mark."""
    text = LEAD.sub("", LINK.sub(r"\1", line))
    n = inside = at = 0
    for m in END.finditer(text):
        part = text[at : m.end()]
        size = len(part.strip())
        if part.count(" ") >= 3 and len(TOKEN.findall(part)) >= 4 or not part.isascii() and len(WIDE.findall(part)) >= 6:
            n += 1
            inside += size
        elif n:
            inside += size
        at = m.end()
    rest = len(text[at:].strip())
    if n and rest and len(TOKEN.findall(text[at:])) >= 4 and n >= 2:
        # a cut last sentence of a paragraph
        inside += rest
        rest = 0
    return n, inside, max(0, len(text.strip()) - inside)


def answer_keys(line: str) -> list[tuple[int, int]]:
    """(key, words) of a line without numbers and marks, then of the line with each of its words blank in turn, since a
    response may name its page or a code.  Fewer than 3 words make no message, and fewer than 5 none with a blank."""
    words = [w if w.isalpha() else "0" for w in TOKEN.findall(line.lower())]
    n = len(words) - words.count("0")
    if n < 3 and not WIDE.search(line):
        return []
    m = (1 << 64) - 1
    parts = [xxhash.xxh64_intdigest(w, i) for i, w in enumerate(words)]
    total = sum(parts) & m
    blank = [(total - p + 0x9E3779B97F4A7C15 * (i + 1)) & m for i, p in enumerate(parts) if words[i] != "0"] if n >= 5 else []
    return [(k - (1 << 63), len(words)) for k in dict.fromkeys([total, *blank])]


def _running(lines: list[str]) -> list[str]:
    """The lines outside code fences, without code spans."""
    out, fence = [], ""
    for x in lines:
        mark = re.match(r"\s*(`{3,}|~{3,})", x)
        if mark:
            fence = "" if fence and mark[1][0] == fence else fence or mark[1][0]
            continue
        if not fence and not x.startswith(("    ", "\t")):
            out.append(re.sub(r"`[^`\n]*`", " ", x))
    return out


COLUMNS = (
    "scrape_id bigint, lang string, n_chars bigint, n_words bigint, mean_word double, symbol_ratio double, punct_lines double,"
    " bullet_lines double, short_lines double, common_share double, alpha_words double, dup_lines double, n_lines int, n_items int, n_sentences int,"
    " prose_chars bigint, item_chars bigint, code_ratio double, content_words bigint, dominance double, repetition double, line_share double, segments int,"
    " packed double, packed_bytes bigint, form double, form_bytes bigint, n_links int, linked_lines int, explained int, tags int, tokens int, placeholder string, filler boolean, note_share double,"
    " fill_share double, answers array<bigint>, answer_lines array<int>, answer_words array<int>, body_lines int, n_sentences_rest int, n_lines_rest int, overlap int, line_key bigint, title_hash bigint, site string"
)


NAMES = [c.split()[0] for c in re.split(r",(?![^<]*>)", COLUMNS)]


def page(sid, site, title, url, lines: list[str], common: dict[str, tuple[str, ...]]) -> tuple:
    text = "\n".join(lines)
    rows = [x for x in lines if not HEAD.match(x)]
    bare_rows = [" ".join(URL.sub(" ", LINK.sub(r"\1 ", x)).split()) for x in rows]
    bare = "\n".join(bare_rows)
    words = TOKEN.findall(bare.lower())
    every = Counter(words)
    lang, common_share = language(every, bare, common)
    chars = len(bare) - bare.count(" ") - bare.count("\n")
    # sentences
    n_sent = prose = item = items = 0
    told = [sentences(x) for x in rows]
    for s, a, b in told:
        n_sent += s
        prose += a
        item += b
        items += s == 0
    # what stays without one sentence at the start
    skip = int(len(rows) > 1 and told[0][0] == 1 and told[0][2] == 0 and not LINK.search(rows[0]))
    rest = rows[skip:]
    low = "\n".join(bare_rows[skip:]).lower()
    tokens = words[len(TOKEN.findall(bare_rows[0])) :] if skip else words
    count = Counter(tokens)
    for t in [t for t in count if t in common or t.isdigit()]:
        del count[t]
    content = sum(count.values())
    n = max(1, content)
    top = [t for t, _ in count.most_common(5)]
    dominance = sum(count[t] for t in top) / n
    repetition = sum(v for v in count.values() if v >= 4) / n
    # the word that the most entries share
    parts = [f" {p} " for p in PARTS.split(low) if p.strip()]
    line_share = max((sum(1 for p in parts if t in p) for t in top[:3]), default=0) / max(1, len(parts))
    raw = low.encode()
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    packed = sum(len(zlib.compress(b, 6)) for b in blocks) / max(1, len(raw))
    # the form: words and numbers as one sign each, what lists of bare links and tags repeat
    shape = DIGITS.sub("0", LETTERS.sub("a", "\n".join(rest))).encode()
    form = sum(len(zlib.compress(shape[i : i + BLOCK], 6)) for i in range(0, len(shape), BLOCK)) / max(1, len(shape))
    n_links = linked = explained = 0
    for x in rest:
        k = len(LINK.findall(x)) + len(URL.findall(LINK.sub(" ", x)))
        n_links += k
        linked += k > 0
        explained += k > 0 and sentences(URL.sub(" ", LINK.sub(" ", x)))[0] > 0
    running = _running(lines)
    flow = "\n".join(running)
    holder = HOLDER.search(flow) if any(x in flow for x in HINTS) else None
    plain = [x for x in running if not HEAD.match(x) and x.strip()]
    latin = sum(count[t] for t in count.keys() & LATIN_FILLER)
    filler = latin > 0.8 * n and latin >= 6
    # terms of address and title that the text, its headings included, holds too
    flat = " ".join(lines)
    named = set(t for t in TOKEN.findall(f"{title or ''} {ADDRESS.sub('', url or '')}".lower()) if len(t) > 2 and t not in common)
    overlap = len(named & set(TOKEN.findall(flat.lower()))) + sum(r[i : i + 2] in flat for r in WIDE_RUN.findall(title or "") for i in range(len(r) - 1))
    noted = filled = whole = 0
    answers: list[tuple[int, int, int]] = []
    if overlap <= 1:  # only a text that does not answer its address and title is searched for what stands in its place
        whole = sum(map(len, plain))
        low_flat = flat.lower()
        hints = [h for h in NOTE_HINTS if h in low_flat]
        for x in plain if hints else ():
            for part in PARTING.split(x):
                low_part = part.lower()
                if any(h in low_part for h in hints):
                    filled += len(part) * bool(FILLER.search(part))
                    noted += len(part) * bool(NOTICE.search(part))
    if overlap == 0:
        answers = [(k, i, w) for i, x in enumerate(lines) for k, w in answer_keys(x)]
    key = xxhash.xxh64_intdigest(re.sub(r"\d+", "0", " ".join(bare.lower().split()))) - (1 << 63)
    ends = sum(1 for x in bare_rows if STOP.search(x[-6:]))
    k = max(1, len(rows))
    return (
        sid, lang, chars, len(words), sum(map(len, words)) / max(1, len(words)), len(SYMBOL.findall(bare)) / max(1, chars), ends / k,
        sum(1 for x in rows if BULLET.match(x)) / k, sum(1 for x in bare_rows if len(x) < 30) / k, common_share,
        sum(v for w, v in every.items() if not w.isdigit()) / max(1, len(words)), 1 - len(set(bare_rows)) / k, len(rows), items, n_sent,
        prose, item, len(CODE.findall(low)) / max(1, len(low)), content, dominance, repetition, line_share, len(parts),
        packed, len(raw), form, len(shape), n_links, linked, explained, len(TAGS.findall(low)), len(tokens), holder[0] if holder else None, filler, noted / max(1, whole),
        filled / max(1, whole), *(zip(*answers) if answers else ((), (), ())), sum(1 for x in lines if x.strip()), sum(t[0] for t in told[skip:]), len(rest), overlap, key, xxhash.xxh64_intdigest((title or "").strip().lower()) - (1 << 63), site,
    )


def page_stats(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """One row of COLUMNS per record with text; written once, since the rules read it several times."""
    pages = table(spark, sf_dir, "scrape_results") if pages is None else pages
    words: dict[str, tuple[str, ...]] = {}
    for lang, word in table(spark, sf_dir, "common_words").select("lang", "word").collect():  # a fixed table of 177 rows
        words[word] = (*words.get(word, ()), lang)
    names = NAMES

    def run(b: pd.DataFrame, bodies: list[list[str]]) -> pd.DataFrame:
        rows = [page(s, h, t, u, x, words) for s, h, t, u, x in zip(b["scrape_id"], b["site"], b["title"], b["url"], bodies)]
        return pd.DataFrame(rows, columns=names)

    return cut(Bodies(pages).apply(["title", "url"], COLUMNS, run).dropDuplicates(["scrape_id"]))
