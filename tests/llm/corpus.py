"""Small tables with every odd case, and plain Python versions of the definitions."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

BLANK = " \t\n\r\x0b\x0c"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ORDINARY = [
    "the quick brown fox jumps over the lazy dog while the small cat sleeps near a warm fire and dreams of mice tonight",
    "der schnelle braune fuchs springt heute nicht weit über den faulen hund und die kleine katze schläft am warmen ofen",
    "le renard brun saute par dessus le chien paresseux pendant que le petit chat dort près du feu et rêve de souris",
]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def remainder(doc_id: int, k: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % k


def texts() -> list[tuple]:
    """(doc_id, text, lang, source)."""
    rows = []
    for i in range(60):
        k = i % 3
        body = ORDINARY[k].split()
        spun = body[i % 7:] + body[:i % 7] + [f"word{i}", f"other{i * 7}"] + body[::-1]
        rows.append((i, " ".join(spun) + ".", ("en", "de", "fr")[k], f"src{i % 4}"))
    for i in range(60, 90):
        rows.append((i, " | ".join(f"item{i}x{j}###" for j in range(40)), "en", "src1"))
    for i in range(90, 110):
        rows.append((i, ORDINARY[0] + f" you {('idiot', '1d10t', 'i d i o t', 'idiiiot')[i % 4]} number{i} " + ORDINARY[0][::-1], "en", None))
    odd = [None, "", "   \n\t", "a", "?!", "x" * 5000, "word " * 3000, "Ünï cödé\x0bÄ \x1f é", "tab\tand\nline\n\nline\nline",
           "12345 67", "MIT License. Apache License, CC BY-SA; gnu general public license",
           "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 \nrest"]
    rows += [(110 + i, t, None if i % 2 else "en", None if i % 3 else "odd") for i, t in enumerate(odd)]
    base = " ".join(f"shared{j}" for j in range(200))
    rows += [(200 + i, base.replace(f"shared{50 + i}", "changed") + (" tail" if i else ""), "en", "src0") for i in range(12)]
    rows += [(300, base, "en", "src0"), (301, base, "en", "src2"), (301, base, "en", "src2"), (None, base, "en", "src2"), (None, None, None, None)]
    return rows


_HEAD = "<!DOCTYPE html><html><head><title>Some title</title><style>p{}</style><script>var a='</p>';</script></head>"
_LONG = "The river rose again in the night and the old bridge, which had stood for longer than anybody knew, gave way at last."
# (page_id, url, html, main text)
PAGES = [
    (0, "http://a.example/0", f"{_HEAD}<body class='with-sidebar'><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News &amp; views</a></li></ul></nav>"
     f"<!-- <p>no</p> --><div class='ad'>Buy this now. It is good, cheap and near.</div><article><header><h1>Caf&eacute; by the&nbsp;river</h1></header><p><b>{_LONG}"
     f"<br><p>Short.</p><p>A &lt;b&gt; is\n no  tag &#8212; <a href='x'>see</a> there.</p><aside>Related: other rivers of the land.</aside></article>"
     "<section id='comments'><article class='comment'><p>I was there that night and saw the bridge fall, what a sight it was.</p></article></section>"
     "<footer>&copy; 2020 All rights reserved</footer></body></html>",
     f"Caf\u00e9 by the river\n{_LONG}\nShort.\nA <b> is no tag \u2014 see there."),
    (1, "http://a.example/1", f"{_HEAD}<body><div id='page' class='layout-sidebar'><div id='header'><a href='/'>The Site</a></div><div class='content'><h2>A heading</h2><p>{_LONG}</p>"
     f"<ul><li>first point</li><li>second point</li></ul><p>{_LONG}</p><form><p>Write to us about this story and all others that we have.</p><input type=text></form></div>"
     "<div id='sidebar'><p>Most read this week, by many people who also liked that.</p></div><div role='contentinfo'>Imprint | Contact</div></div></body></html>",
     f"A heading\n{_LONG}\nfirst point\nsecond point\n{_LONG}"),
    (2, None, f"{_HEAD}<body><div><p>{_LONG}</p><p>{_LONG}</p></div><div class='cookie-notice'>We use cookies to make this page better for you.</div><p style='display: none'>hidden words</p>", f"{_LONG}\n{_LONG}"),
    (3, "http://a.example/3", None, ""), (4, "http://a.example/4", "", ""), (4, "http://a.example/4", " \n ", ""), (None, None, "<nav>only a menu</nav>", ""),
    (5, "u", f"<article><p>{_LONG}</p><p>cut off &am", f"{_LONG}\ncut off &am"),
    (6, "u", "<article>" + f"<p>{_LONG}</p>" * 3000 + "<div><p><span>" * 500, "\n".join([_LONG] * 3000)),
    (7, "u", f"<main><p>{_LONG}</p><script>never closed <p>no</p>", _LONG),
    (8, "u", f"<article><p title='a > b'>1 < 2 and {_LONG}</p></article>", f"1 < 2 and {_LONG}"),
]
_TEXT = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
# columns that share a name with what the operators add
_CLASHES = {"score": pa.float64(), "kept": pa.string(), "size": pa.int64(), "words": pa.int64(), "copy": pa.string(), "shard": pa.int64(),
            "place": pa.int64(), "target": pa.float64(), "component_id": pa.int64(), "label": pa.int64(), "_score": pa.int64(), "rank": pa.int64(),
            "key": pa.int64(), "id": pa.int64(), "n": pa.int64(), "_doc": pa.int64(), "_start": pa.int64(), "same": pa.int64()}


def write(folder: str, empty: bool = False) -> list[tuple]:
    rows = [] if empty else texts()
    documents = {c: pa.array([], t) for c, t in _TEXT.items()} if empty else {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()),
        "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}
    documents |= {c: pa.nulls(len(rows), t) for c, t in _CLASHES.items()}
    pq.write_table(pa.table(documents), f"{folder}/documents.parquet")
    labels = [] if empty else [(r[0], int(not (60 <= (r[0] or 0) < 90)), int(90 <= (r[0] or 0) < 110)) for r in rows if r[0] is not None]
    labels += [] if empty else [(None, 1, 1), (3, None, None), (3, 1, 0), (9_999, 0, 1)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()),
                             "toxic": pa.array([x[2] for x in labels], pa.int32()), "score": pa.nulls(len(labels), pa.float64())}),
                   f"{folder}/labels.parquet")
    vectors = [] if empty else [(i, [((i * 37 + j * 11) % 101 - 50) / 40 for j in range(8)]) for i in range(0, 400, 2)]
    vectors += [] if empty else [(50, None), (100, [None] * 8), (150, [float("nan")] + [0.0] * 7), (7, [float("inf")] * 8), (None, [1.0] * 8),
                                 (2, vectors[1][1]), (9, [1.0, 2.0]), (450, [0.5, 0.25]), (500, []), (11, []), (13, vectors[3][1])]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())),
                             "label": pa.nulls(len(vectors), pa.int32()), "score": pa.nulls(len(vectors), pa.int64())}), f"{folder}/embeddings.parquet")
    pages = [] if empty else PAGES
    pq.write_table(pa.table({"page_id": pa.array([x[0] for x in pages], pa.int64()), "url": pa.array([x[1] for x in pages], pa.string()),
                             "html": pa.array([x[2] for x in pages], pa.string()), "text": pa.nulls(len(pages), pa.int64()),
                             "n_chars": pa.nulls(len(pages), pa.string())}), f"{folder}/pages.parquet")
    return rows
