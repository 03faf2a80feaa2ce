"""Near-duplicates, pieces, chats, pages and the pipeline on small tables."""

import hashlib
import os
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwright.llm import chat, near_dedup, sentencepiece_codec
from poolwright.llm.html_text import extract_text, visible_text

HERE = os.path.exists(sentencepiece_codec.MODEL_FILE)
needs_model = pytest.mark.skipif(not HERE, reason="the public tokenizers are not here")


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[:700], np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))])
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sign = near_dedup.dart_signatures([a, b, a[:3]], 2000)
    assert abs((sign[0] == sign[1]).mean() - want) < 0.05
    alone = near_dedup.dart_signatures([b], 2000)
    assert (alone[0] == sign[1]).all()  # what is signed together doesn't matter


def test_repeats_are_weights():
    h = near_dedup.WordHashes()
    once, thrice = (near_dedup.shingle_layers(h(("a b c d e " * n).split())) for n in (1, 3))
    assert len(once) == 1 and len(thrice) == 11 and len(np.intersect1d(once, thrice)) == 1
    assert len(near_dedup.shingle_layers(h(["a"]))) == 1 and len(near_dedup.shingle_layers(h([]))) == 0


def brute_classes(rows):
    layers = [near_dedup._layers_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similar(layers[i], layers[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return {d: (min(g), len(g)) for g in groups.values() for d in g}


def test_near_duplicates(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):  # a family of copies, some changed much, some copied from copies
        words = list(base if i < 40 or not rows else rows[rng.randrange(len(rows))][1].split())
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(40)])) for i in range(30)]
    rows += [(200 + i, rows[3][1].replace(" ", "\n")) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "one  two"), (304, "very long " * 20000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_classes(rows)
    got = near_dedup.near_duplicates(table).collect()
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got} == want and len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == {c for c, _ in want.values()}


def test_near_dedup_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x", 9), (1, "a b c d e f", "y", 9), (None, "a b c d e f", "z", 9), (None, None, "q", 9), (5, "", "q", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, uid string, label int")
    out = near_dedup.near_dedup(table)
    assert out.columns == table.columns
    got = out.collect()
    assert len(got) == 3 and sum(r["doc_id"] == 1 for r in got) == 1
    assert near_dedup.near_dedup(table.limit(0)).count() == 0


@needs_model
def test_pieces_are_those_of_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_FILE)
    codec = sentencepiece_codec.SentencePieceCodec(sentencepiece_codec.PieceModel.load(sentencepiece_codec.MODEL_FILE))
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "the", "ing", "\t", "0", "😀", "</s>", "▁", "st", "x" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", " " * 300, "ab" * 5000]
    for text in texts:
        ids = codec.encode(text)
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids) == text.replace("▁", " ")


@needs_model
def test_streaming_forgets_and_agrees():
    codec = sentencepiece_codec.SentencePieceCodec(sentencepiece_codec.PieceModel.load(sentencepiece_codec.MODEL_FILE))
    text = "".join(random.Random(2).choice("etaoinshrdlu") for _ in range(6000))
    search, pieces, held = codec.search(), [], 0
    for i in range(0, len(text), 7):
        pieces += search.feed(text[i : i + 7])
        held = max(held, len(search.last))
    pieces += search.finish()
    assert "".join(pieces) == text and held < 20 * codec.longest
    assert pieces == codec.merged(text)


@needs_model
def test_prose_is_committed_while_it_streams():
    codec = sentencepiece_codec.SentencePieceCodec(sentencepiece_codec.PieceModel.load(sentencepiece_codec.MODEL_FILE))
    text = "the people of the town were not at all surprised, said the old man, by what they found there. " * 200
    marked = sentencepiece_codec.SPACE + text.replace(" ", sentencepiece_codec.SPACE)
    search, pieces, held = codec.search(), [], 0
    for at, char in enumerate(marked, 1):
        pieces += search.feed(char)
        assert len(search.window) <= codec.longest
        assert all(at - codec.longest < start <= at for start, _, _ in search.window)
        held = max(held, search.at - search.done)
    assert search.commits > len(marked) / 10 and held <= 2 * codec.longest
    pieces += search.finish()
    assert codec.ids_of([codec.model.ids[p] for p in pieces]) == codec.encode(text).tolist()


@needs_model
def test_every_word_goes_through_the_streaming_search(monkeypatch):
    codec = sentencepiece_codec.SentencePieceCodec(sentencepiece_codec.PieceModel.load(sentencepiece_codec.MODEL_FILE))
    seen, search = [], codec.search
    monkeypatch.setattr(codec, "search", lambda: seen.append(search()) or seen[-1])
    monkeypatch.setattr(sentencepiece_codec, "MAX_WORDS", 3)
    words = ["word" + "abcdefghij"[i] for i in range(10)] + ["x" * 200]
    codec.encode(" ".join(words))
    assert sum(s.at for s in seen) == sum(map(len, words)) + len(words)
    assert len(codec.words) <= 3 and len(codec.words.before) <= 3
    codec.encode("wordj")
    assert len(seen) == len(words)


def test_unigram_is_the_best_cut():
    class Toy:
        unigram, prefix, byte_ids, unk_id = True, "", {}, 0
        ids = {"a": 1, "b": 2, "ab": 3, "ba": 4, "abb": 5, "bab": 6}
        scores = [0.0, -2.0, -2.2, -2.5, -2.4, -4.1, -3.3]

    codec = sentencepiece_codec.SentencePieceCodec(Toy())

    def best(text):
        score = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = Toy.ids.get(text[start:end])
                if piece:
                    score[end] = max(score[end], score[start] + Toy.scores[piece])
        return score[-1]

    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))
        search = codec.search()
        pieces = search.feed(text) + search.finish()
        assert "".join(pieces) == text and sum(Toy.scores[Toy.ids[p]] for p in pieces) == pytest.approx(best(text))


@needs_model
def test_encode_documents(spark):
    rows = [(1, "some text\nhere", 5), (2, None, 5), (None, "", 5), (4, "wörds " * 9000, 5), (4, "wörds " * 9000, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = sentencepiece_codec.encode_documents(table)
    got = out.collect()
    assert len(got) == 5 and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)
    texts = Counter(r["text"] for r in sentencepiece_codec.decode_documents(out).collect())
    assert texts == Counter(t or "" for _, t, _ in rows)
    assert sentencepiece_codec.encode_documents(table.limit(0)).count() == 0


EVENTS = "conv_id long, message_id long, seq long, kind string, role string, text string"


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "delta", "assistant", "he"), (1, 1, 2, "delta", None, "llo"),
        (1, 0, 3, "edit", None, "hi there"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "good "), (1, 1, 6, "delta", None, "day"),
        (2, None, None, "delta", None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()
    assert {(r["conv_id"], r["seq"], r["role"], r["text"]) for r in got} == {
        (1, 0, "user", "hi there"), (1, 1, "assistant", "good day"), (2, None, None, ""),
    }
    assert chat.fold_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_formatting_is_reversible(spark):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "\\", "<", "[", "\n", "a", "é", "</", "s>", "<\\/s>"]
    rows, turns = [], defaultdict(list)
    for conv in range(60):
        for turn in range(rng.randrange(1, 600 if conv == 0 else 5)):
            role = rng.choice(["user", "assistant", "sys\ntem\\n", "<|im_end|>\n"])
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
            rows.append((conv, len(rows), turn, "message", role, text))
            turns[conv].append((role, text))
    out = chat.format_conversations(spark.createDataFrame(rows, EVENTS))
    for r in out.collect():
        assert sum(t["chars"] for t in r["turns"]) == len(r["formatted"])
        assert r["formatted"].count(chat.START) == len(turns[r["conv_id"]]) == r["formatted"].count(chat.END)
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    for r in chat.read_back(out).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns[r["conv_id"]]
        assert "".join(r["loss"]) == "".join(t for role, t in turns[r["conv_id"]] if role == "assistant")


PAGE = """<html><head><title>T</title><style>x</style></head><body><h1>Hi  there</h1><p>one <b>two</b><br>three<p>four
<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>Age<tr><td>Bob<td>5<tr><td>Al<br>ice<td>77</table>tail
<div hidden>no</div><div style="color:red; display:none">no</div><pre>
 a
   b</pre>&lt;x&gt; 1<2 <script>var a="</p>"</script>end<!-- no --></body></html>"""
TEXT = """Hi there

one two
three

four

- a
- b
  1. x
  2. y
- c

Name  Age
Bob   5
Al    77
ice

tail

 a
   b

<x> 1<2 end"""


def test_page_layout():
    assert visible_text(PAGE) == TEXT


class Pages:
    """Random pages, each with its text rendered recursively from what it was made of; None stands for an empty line."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def words(self, most=5):
        return " ".join(self.rng.choice(["a", "bb", "Ccc", "d1", "eé"]) for _ in range(self.rng.randint(1, most)))

    def end(self, tag):
        return self.rng.choice([f"</{tag}>", f"</{tag.upper()}>\n", ""])

    def block(self, depth, visible=True):
        kind = self.rng.choice(["p", "div", "list", "table", "hidden", "unseen", "details", "dialog", "h2", "form", "kept"])
        if kind == "form":
            page, lines = self.form()
            return page, lines if visible else []
        if kind == "kept":
            lines = [" " * self.rng.randint(0, 2) + self.words() + "  z" for _ in range(2)]
            style = self.rng.choice(["white-space:pre", "color:red; white-space: pre-wrap"])
            return f'<div style="{style}">' + "\n".join(lines) + "</div>", lines if visible else []
        if depth > 2 or kind in ("p", "h2"):
            text = self.words()
            close = self.end("p") if kind != "h2" else "</h2>"
            tag = "h2" if kind == "h2" else "p"
            return f"<{tag}> {text}\n{close}", [None, text, None] if visible else [None]
        if kind == "list":
            page, lines = self.list(0)
            return page, [None, *(lines if visible else []), None]
        if kind == "table":
            page, lines = self.table()
            return page, [None, *(lines if visible else []), None]
        page, lines = self.blocks(depth + 1, visible or kind == "unseen")
        if kind == "div":
            return f"<div>{page}</div>", lines
        if kind == "hidden":
            tags = ["hidden", 'style="color:red;display: none"', 'class="a gone"', "id=off", "hidden class=dim"]
            return f"<div {self.rng.choice(tags)}>{page}</div>", []
        if kind == "unseen":
            inner, unseen = self.blocks(depth + 1, False)
            dim = self.rng.choice(['style="visibility:hidden"', "class=dim"])
            return f'<div {dim}>lost{inner}<div style="visibility: visible">{page}</div></div>', [*unseen, *lines]
        is_open = self.rng.random() < 0.5
        if kind == "dialog":
            return f"<dialog{' open' * is_open}>{page}</dialog>", lines if is_open else []
        title = [self.words()] if visible else []
        return f"<details{' open' * is_open}><summary>{''.join(title)}</summary>{page}</details>", [*title, *(lines if is_open else [])]

    def blocks(self, depth, visible=True):
        made = [self.block(depth, visible) for _ in range(self.rng.randint(1, 4))]
        return "".join(page for page, _ in made), [line for _, lines in made for line in lines]

    def list(self, depth):
        numbered, n = self.rng.random() < 0.6, self.rng.randint(1, 4)
        start, backwards = self.rng.choice([None, 7, -2]), numbered and self.rng.random() < 0.3
        number, page, out = (n if backwards else 1) if start is None else start, "", []
        for _ in range(n):
            value = self.rng.choice([None, None, 30])
            number = number if value is None else value
            marker = f"{number}. " if numbered else "- "
            text = self.words()
            inner, lines = self.list(depth + 1) if depth < 2 and self.rng.random() < 0.3 else ("", [])
            shown = f' value="{value}"' * (numbered and value is not None)
            page += f"<li{shown}>{text}{inner}{self.end('li')}"
            out += [marker + text, *(" " * len(marker) + line for line in lines)]
            number += -1 if backwards else 1
        tag = "ol" if numbered else "ul"
        opening = tag + f" start={start}" * (numbered and start is not None) + " reversed" * backwards
        return f"<{opening}>{page}</{tag}>", out

    def form(self):
        typed, said, label, option = (self.words() for _ in range(4))
        fields = [
            (f'<input value="{typed}">', typed),
            (f'<input type=text placeholder="{said}" value="{typed}">', typed),
            (f'<input placeholder="{said}">', said),
            ("<input type=password value=secret>", ""),
            ("<input type=checkbox value=on>", ""),
            ("<input type=submit>", "Submit"),
            (f"<textarea placeholder=p>\n{typed}</textarea>", typed),
            (f'<textarea placeholder="{said}"></textarea>', said),
            (f"<ruby>{typed}<rp>(</rp></ruby>", typed),
            (f"<q>{typed} <q>{said}</q></q>", f"\u201c{typed} \u2018{said}\u2019\u201d"),
        ]
        made = self.rng.sample(fields, 3)
        line = " ".join(shown for _, shown in made if shown)
        choice = self.rng.choice([f"<option>{option}", f'<option label="{option}">value'])
        select = f'<select><optgroup label="{label}">{choice}</select>'
        return f"<div>{' '.join(field for field, _ in made)}</div>{select}", [*[line] * bool(line), label, option]

    def table(self):
        n_rows, page, grid, starts = self.rng.randint(1, 4), "", {}, []
        for r in range(n_rows):
            page, at = page + "<tr>", 0
            for _ in range(self.rng.randint(1, 3)):
                while (r, at) in grid:
                    at += 1
                lines = [self.words(2) for _ in range(self.rng.randint(1, 2))]
                columns, rows = self.rng.choice([1, 1, 2]), self.rng.choice([1, 1, 1, 2, 0])
                starts.append((r, at, columns, lines))
                for below in range(r, n_rows if not rows else min(n_rows, r + rows)):
                    for c in range(at, at + columns):
                        grid[below, c] = True
                page += f"<td colspan={columns} rowspan={rows}>{'<br>'.join(lines)}{self.end('td')}"
                at += columns
            page += self.end("tr")
        foot = self.rng.random() < 0.4
        if foot:
            starts += [(n_rows, c, 1, [self.words(2)]) for c in range(2)]
            cells = "".join(f"<td>{lines[0]}" for r, *_, lines in starts if r == n_rows)
            page = f"<tfoot><tr>{cells}</tfoot><tbody>{page}{self.end('tbody')}"
        wide = [max((len(x) for _, c, n, lines in starts if (c, n) == (i, 1) for x in lines), default=0) for i in range(99)]
        out = []
        for r in range(n_rows + foot):
            row = [x for x in starts if x[0] == r]
            for k in range(max(len(lines) for *_, lines in row)):
                line = ""
                for _, at, _, lines in row:
                    if k < len(lines):
                        begin = sum(wide[:at]) + 2 * at
                        if line and len(line) + 2 > begin:
                            out.append(line)
                            line = ""
                        line = line.ljust(begin) + lines[k]
                out.append(line)
        return f"<table>{page}</table>", out


SHEET = """<style media="screen">/* .a {display:none} */ .gone, #off {display:none} div.dim { visibility : hidden; color:red }
@media print { div, p { display: none } } @import "x"; p > .a, .a:hover {display:none}</style>"""


def test_pages_as_a_second_renderer_has_them():
    for seed in range(400):
        page, lines = Pages(seed).blocks(0)
        want = []
        for line in lines:
            if line is not None:
                want.append(line)
            elif want and want[-1] is not None:
                want.append(None)
        assert visible_text(f"{SHEET}<body>{page}") == "\n".join(line or "" for line in want).strip("\n"), page


def test_style_sheets_rank_their_rules():
    shown = lambda css, tag="<p class='a' id=i>": visible_text(f"<style>{css}</style>{tag}x</p>") == "x"
    assert not shown("p{display:none}") and not shown("*{display:none}") and not shown("P.a{display:none}")
    assert shown("p{display:none} .a{display:block}") and not shown("#i{display:none} .a{display:block}")
    assert shown("#i{display:none} .a{display:block !important}") and not shown(".a{display:block} .a{display:none}")
    assert shown("p{display:none}", "<p style='display:block'>") and shown("p{display:none", "<div>")
    assert not shown("p{display:none!important}", "<p style='display:block'>")
    assert shown("p{display:block}", "<p hidden>") and shown("@supports (x:y) {p{display:none}}")
    assert not shown("@media screen, print {p{display:none}}") and shown("@media (min-width: 9px) {p{display:none}}")
    assert not shown("}}p{display:none}") and shown("script{display:block}") and shown("p b{display:none}")
    assert visible_text("<style media=print>p{display:none}</style><template><style>p{display:none}</style></template><p>x") == "x"


def test_parts_of_tables_and_white_space():
    table = "<table><tfoot><tr><td>f</tfoot><tfoot><tr><td>g</tfoot><tr><td>b<tbody><tr><td>c<thead><tr><td>h</table>"
    assert visible_text(table) == "h\ng\nb\nc\nf"
    assert visible_text("<table><tr><td>\u65e5\u672c<td>x<tr><td>abcdef<td>y</table>") == "\u65e5\u672c    x\nabcdef  y"
    assert visible_text('<div style="white-space: pre-line">a  b\n c<p style="white-space:normal">d\n e</div>') == "a b\nc\n\nd e"
    assert visible_text("<pre>\r\na\r\n b</pre><xmp><b></xmp>") == "a\n b\n\n<b>"
    wide = "<table><tr>" + f"<td>{'x' * 70}" * 99 + "<tr><td colspan=98><td>y</table>"
    assert visible_text(wide) == "  ".join(["x" * 70] * 99) + "\ny"


def test_pages_take_linear_time():
    n = 40_000
    pages = ["<b><table>" + "<i>" * n + "</b>" * n, "<p><table>" * n, "<ul><li>a" * n, "<blockquote>a" * n]
    pages.append("<style>" + "".join(f".a{i}{{display:none}}" for i in range(n)) + "</style>" + "<p class='a b c'>x" * n)
    for page in pages:
        began = time.process_time()
        assert visible_text(page).count("a") == page.count("a") * (page[:2] in ("<u", "<b") and page[:3] != "<b>")
        assert time.process_time() - began < 12  # minutes if it were quadratic


def test_long_cells_stay_aligned():
    rows = visible_text(f"<table><tr><td>{'x' * 60}<td>q<tr><td>s<td>t<tr><td>{'y' * 200}<td>u</table>").split("\n")
    assert [row.find(c) for row, c in zip(rows, "qt")] == [82, 82] and rows[3] == " " * 82 + "u"


def test_broken_pages():
    for page in (None, "", "<", "<a", "<a href='x", "<!--", "</p></table>", "<table><td>x", "<p" * 9999, "<div>" * 9999 + "x"):
        visible_text(page)
    assert visible_text("<p it's>a</p><a href='x>y' title=\"q\">b</a>") == "a\n\nb"
    assert visible_text("<td>lone <li>item") == "lone\n- item"


def test_extract_text(spark):
    rows = [(1, PAGE, "t"), (1, PAGE, "t"), (None, None, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert Counter(r["text"] for r in extract_text(pages).collect()) == {TEXT: 2, "": 1}
    assert extract_text(pages.limit(0)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passes_quality(text):
    w, lines = plain_words(text), [x for x in (text or "").split("\n") if plain_words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    chars = sum(map(len, w))
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    symbols, capitals = sum(c in "#*$%&|<>" for c in text), sum(c.isupper() for c in text)
    bad = 10 * symbols > 3 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or 100 * capitals > 40 * chars
    return not (bad or chars < 2 * len(w) or chars > 25 * len(w))


def without_seen_lines(texts):
    """{id: text}, lines of ten characters or more only in the first document that has them."""
    owner, out = {}, {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            owner.setdefault(line.strip(" \t\x0b\x0c\r").lower(), i)
        keep = [x for x in texts[i].split("\n") if len(x.strip(" \t\x0b\x0c\r")) < 10 or owner[x.strip(" \t\x0b\x0c\r").lower()] == i]
        out[i] = "\n".join(keep)
    return out


def first_of_near(texts):
    shingles = {i: Counter(zip(*(plain_words(t)[k:] for k in range(5)))) for i, t in texts.items()}
    least = {i: i for i in texts}

    def find(i):
        return i if least[i] == i else find(least[i])

    for i in texts:
        for j in texts:
            both, either = sum((shingles[i] & shingles[j]).values()), sum((shingles[i] | shingles[j]).values())
            if i < j and 10 * both >= 8 * either:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


@needs_model
def test_pipeline(spark, tmp_path):
    """The rows that come out, against the stages written as plain loops; pieces are those of the library."""
    import sentencepiece

    import corpus_pipeline
    from poolwright.llm.sentencepiece_codec import MODEL_FILE

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(12)
    rows = [(i, f"{text(60 + 3 * (i % 7))}\n{shared}\n{text(30)}", "en", "abc"[i % 7 % 3], 0) for i in range(30)]
    rows += [(100, rows[0][1] + " more", "en", "a", 0), (101, "junk", "en", "b", 0), (102, None, None, None, None)]
    near = text(150), text(150)
    rows += [(106, "\n".join(near), "en", "a", 0), (107, " tail\n".join([*near, ""]), "en", "c", 0)]
    rows += [(103, rows[4][1].replace("w1", "W1", 1), "en", "c", 0), (104, "# " * 90 + text(60), "en", "c", 0), (105, f"{shared}\n" * 40, "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = first_of_near(without_seen_lines({r[0]: r[1] for r in rows if passes_quality(r[1])}))
    assert {101, 102, 104, 105, 107}.isdisjoint(left) and len(left) >= 30
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= set(left) and max(times.values()) <= 2
    for r in out:
        assert list(r["ids"]) == library.encode(left[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) and r["round_trip"]
    source = {r[0]: r[3] for r in rows}
    size = {i: len(plain_words(t)) for i, t in left.items()}
    of = lambda s: [n for i, n in size.items() if source[i] == s]
    weight, cap = {"a": 3, "b": 1, "c": 2}, {s: 2 * sum(of(s)) for s in "abc"}
    budget, target, free = 1.5 * sum(size.values()), {}, set("abc")
    while True:  # give out by weight; whoever is above twice its size stops there
        level = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if level[s] > cap[s]}
        if not full:
            target |= level
            break
        target |= {s: cap[s] for s in full}
        budget -= sum(cap[s] for s in full)
        free -= full
    for s in "abc":
        sums = {0}
        for n in of(s):
            sums |= {x + n for x in sums}
        whole = int(target[s] // sum(of(s))) * sum(of(s))
        taken = sum(size[i] * n for i, n in times.items() if source[i] == s)
        assert abs(taken - target[s]) == min(abs(whole + x - target[s]) for x in sums)
        assert len({n for i, n in times.items() if source[i] == s}) <= 2


@needs_model
def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows and columns named as an operator might name its own."""
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words, "en", "s", 9, "u", 1), (1, words, "en", "s", 9, "u", 1), (None, None, None, None, None, None, None), (2, "", "en", None, 0, "", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid string, __nth int"
    docs = spark.createDataFrame(rows, schema)
    want = {"quality_rules": 2, "line_dedup": 4, "near_dedup": 3, "source_mixing": None, "sentencepiece": 4}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        n = out.count()
        assert want[name] in (n, None) and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns
    assert {r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()} <= {1}


def test_registered_queries_agree_with_their_sql(spark):
    import duckdb

    import __spark_entry__

    sf, queries, sql = "/root/testdata/sf0.001", __spark_entry__.queries(), __spark_entry__.oracle_sql()
    if not os.path.isdir(sf):
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for name in ("op3_quality_rules", "op4_exact_dedup", "op7_chat_format", "op9_line_dedup"):
        df = queries[name](spark, sf)
        columns = sorted(df.columns)
        found = con.execute(sql[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        assert Counter(map(tuple, df.select(*columns).collect())) == Counter(tuple(r[i] for i in at) for r in found.fetchall())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_duplicates_on_plain_counters(spark):
    """Classes by multisets of five-word tuples, without any code of the operator."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(900)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy + copy[: rng.choice([0, 0, 20])])))
    grams = []
    for _, text in rows:
        w = words_of(text)
        grams.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    parent = list(range(len(rows)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            both, either = (grams[i] & grams[j]).total(), (grams[i] | grams[j]).total()
            if 5 * both >= 4 * either:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(table).collect()}
    sizes = Counter(top(i) for i in range(len(rows)))
    assert got == {i: (top(i), sizes[top(i)]) for i in range(len(rows))}
