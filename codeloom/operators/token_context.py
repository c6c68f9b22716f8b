"""X1–X3 within a task: positions, depths, brackets and context of the tokens of
whole files, as array operations over all files of an Arrow batch at once.

Every value is a running one over a file's tokens: sums are differences of one
cumulative sum, the latest token of a kind is a running maximum of places, and the
matching close of a bracket is the next one of its file, family and level.  A
token's text is looked at once for each distinct text.  Only the tokens that an
extractor reads leave the task (``relevant``), so no sort or window ever holds the
token stream.  Spark deals the files by path and sorts them, so that a path's rows
come together; rows of one path are one stream, ordered by token number."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are worked on at a time (one path at least).
STEP = 100_000

_CLOSE = ("idx int, text string, char_off bigint, char_end bigint, end_line int, end_bcol int, cum_dec bigint, adepth bigint")
_TOKEN = ("idx int, text string, kind string, line int, bcol int, end_bcol int, char_off bigint, char_end bigint, close struct<"
          + _CLOSE.replace(" int", ":int").replace(" string", ":string").replace(" bigint", ":bigint") + ">")
_NESTED = re.sub(r"(\w+) (int|string|bigint|struct)", r"\1:\2", _TOKEN)
_END = "char_end:bigint,end_line:int,end_bcol:int,cum_dec:bigint"
#: One row for each relevant token, and one for each file (``idx`` -1) with its
#: content and masked content.
SCHEMA = ("file_path string, language string, content string, masked string, idx int, kind string, text string, char_off bigint, char_end bigint, "
          "line int, ccol int, bcol int, end_line int, end_bcol int, bdepth bigint, pdepth bigint, adepth bigint, dec int, cum_dec bigint, ll bigint, "
          f"ll_start boolean, close struct<{re.sub(r'(\w+) (int|string|bigint)', r'\1:\2', _CLOSE)}>, nxt1 string, prv1 string, prv2 string, pkind1 string, "
          + "".join(f"t{i} struct<{_NESTED}>, " for i in (1, 2, 3))
          + f"prev_end struct<{_END}>, file_end struct<{_END}>, stmt string, stmt_no bigint, imp_grp struct<o:int,c:int>, typ_grp struct<o:int,c:int>, "
          "decl_start struct<idx:int,line:int,bcol:int,char_off:bigint>, file_balanced boolean")

# Java words after which an expression may start, words that a
# parenthesis must follow, and words that none of ``= ) ] , .`` can follow.
BEFORE_LITERAL = ["return", "case", "throw", "assert", "yield", "else", "do", "default", "when"]
BEFORE_PARENTHESIS = ["if", "while", "for", "switch", "catch"]
BEFORE_OPERAND = ["return", "throw", "new", "case", "import", "package", "extends", "implements", "throws"]
#: Words that no Java method is named by, though a parenthesis may follow them.
NOT_CALLED = ["if", "while", "for", "switch", "catch", "return", "synchronized", "new", "throw", "this", "super", "assert", "case"]
#: Words that an extractor reads wherever they stand.
DECLARATION_WORDS = ["def", "class", "async", "func", "type", "import"]

_KINDS = np.array(["punct", "word", "str"])
PUNCT, WORD, STR = 0, 1, 2


def is_word_character(c: str) -> bool:
    """``\\w`` in its Unicode meaning, as the tokens' patterns have it."""
    return (unicodedata.category(c) in {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"} or c in "‌‍"
            or any(a <= ord(c) <= z for a, z in ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))))


def interpolated_decisions(tok: str, words: re.Pattern) -> int:
    """Decision words of the expressions in an f-string's braces (doubled braces
    and strings within the expressions aside)."""
    expressions = " ".join(re.findall(r"\{([^{}]*)", re.sub(r"\{\{|\}\}", "", tok)))
    return len(words.findall(re.sub(r"'[^']*'|\"[^\"]*\"", " ", expressions)))


_F_STRING = re.compile("[rRbBuU]?[fF][rR]?[\"']")


@dataclass(frozen=True)
class Context:
    """What languages give: decision words, the line comment of those whose lines
    end statements, words to keep, and what a piece's trivia is."""

    decisions: dict[str, tuple[str, ...]]
    indented: dict[str, str]
    words: tuple[str, ...]
    trivia: dict[str, str]
    schema: pa.Schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_paths(batches):
            sizes = _sizes(b)
            path = pc.dictionary_encode(b.column("file_path"), null_encoding="encode").indices.to_numpy()
            at = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])          # first row of each path
            ends, upto = np.r_[at[1:], len(path)], np.cumsum(sizes)
            i = 0
            while i < len(at):
                before = upto[at[i] - 1] if at[i] else 0
                j = max(i + 1, int(np.searchsorted(upto[ends - 1], before + STEP, side="right")))
                part = b.slice(at[i], ends[j - 1] - at[i])
                trivia, text = self._split(part)
                tokens, balanced = self._tokens(part, trivia, text)
                yield self._files(part, trivia, text, balanced)
                if tokens is not None:
                    yield tokens
                i = j

    def _split(self, b: pa.RecordBatch) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Trivia and token of each piece.  Each distinct piece of a language is looked
        at once: its trivia is what the language's trivia pattern takes from its start."""
        piece = b.column("pieces").flatten().dictionary_encode()
        lang = pc.dictionary_encode(b.column("language"))
        names, of = lang.dictionary.to_pylist(), np.repeat(pc.fill_null(lang.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), _sizes(b))
        both, one = np.unique(piece.indices.to_numpy().astype(np.int64) * max(len(names), 1) + of, return_inverse=True)
        patterns = [re.compile(self.trivia.get(x, ""), re.ASCII) for x in names]
        words = piece.dictionary.to_pylist()
        cut = [(w, patterns[k].match(w).end()) for w, k in ((words[x // len(names)], x % len(names)) for x in both.tolist())]

        def column(parts):
            d = pa.array(parts, pa.string()).dictionary_encode()
            return pa.DictionaryArray.from_arrays(pa.array(d.indices.to_numpy()[one], pa.int32()), d.dictionary)

        return column([w[:e] for w, e in cut]), column([w[e:] for w, e in cut])

    def _files(self, b: pa.RecordBatch, trivia: pa.DictionaryArray, text: pa.DictionaryArray, balanced: pa.Array) -> pa.RecordBatch:
        """The files' rows: trivia (comments, white space) blanked to spaces, newlines kept,
        and whether the path's Java tokens are balanced (null: there are none)."""
        blanked = pa.array([re.sub("[^\n]", " ", t) for t in trivia.dictionary.to_pylist()], pa.string())
        m = len(blanked)
        both = pa.concat_arrays([blanked, text.dictionary]).take(pa.array(np.stack([trivia.indices.to_numpy(), text.indices.to_numpy() + m], 1).ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * _sizes(b))], pa.int32()), both)
        masked = pc.if_else(b.column("pieces").is_valid(), pc.binary_join(lists, ""), pa.scalar(None, pa.string()))
        held = {"file_path": b.column("file_path"), "language": b.column("language"), "content": b.column("content"), "masked": masked, "file_balanced": balanced,
                "idx": pa.array(np.full(len(b), -1), pa.int32())}
        return pa.RecordBatch.from_arrays([held[f.name] if f.name in held else pa.nulls(len(b), f.type) for f in self.schema], schema=self.schema)

    def _tokens(self, b: pa.RecordBatch, trivia: pa.DictionaryArray, text: pa.DictionaryArray) -> tuple[pa.RecordBatch | None, pa.Array]:
        sizes = _sizes(b)
        row = np.repeat(np.arange(len(b)), sizes)
        idx = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code, tcode = text.indices.to_numpy().astype(np.int64), trivia.indices.to_numpy().astype(np.int64)
        texts, trivias = text.dictionary, trivia.dictionary
        path = pc.dictionary_encode(b.column("file_path"), null_encoding="encode").indices.to_numpy().astype(np.int64)
        some = np.flatnonzero(pc.not_equal(texts, "").to_numpy(zero_copy_only=False)[code]) if len(texts) else np.zeros(0, np.int64)
        if path.size > 1 and len(np.unique(path)) < len(path):               # a path's rows are one stream
            some = some[np.lexsort((idx[some], path[row[some]]))]
        if not len(some):
            return None, pa.nulls(len(b), pa.bool_())
        row, idx, code, tcode = row[some], idx[some], code[some], tcode[some]
        n, here = len(some), np.arange(len(some))
        group = path[row]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        length = np.diff(np.r_[starts, n])
        first, last = np.repeat(starts, length), np.repeat(starts + length - 1, length)

        def total(x):
            c = np.cumsum(x, dtype=np.int64)
            return c - (c[first] - x[first])

        def latest(flag):
            """Place of the latest flagged token of the path up to here, else -1."""
            p = np.maximum.accumulate(np.where(flag, here, -1))
            return np.where(p >= first, p, -1)

        def neighbour(k):
            p = here + k
            return np.where((p >= first) & (p <= last), p, -1)

        # Facts of each distinct text.
        number = {w: k + 1 for k, w in enumerate(dict.fromkeys([
            *"()[]{};:,.=/%^&|!~<>?*+-", "from", "new", "enum", "interface", "struct", "instanceof", *DECLARATION_WORDS, *BEFORE_LITERAL, *BEFORE_PARENTHESIS, *BEFORE_OPERAND, *NOT_CALLED,
            *self.words, *(w for ws in self.decisions.values() for w in ws)]))}
        value_set = pa.array(list(number), pa.string())
        known = pc.fill_null(pc.add(pc.index_in(texts, value_set), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ints = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
        u_len, u_bytes, u_nls = ints(pc.utf8_length(texts)), ints(pc.binary_length(texts)), ints(pc.count_substring(texts, "\n"))
        quoted = [ints(pc.match_substring(texts, q)).astype(bool) for q in "'\""]
        tick = ints(pc.starts_with(texts, "`")).astype(bool)
        u_kind = np.where(quoted[0] | quoted[1] | tick, STR, np.where(u_len > 1, WORD, PUNCT))
        for k in np.flatnonzero(u_len == 1):
            u_kind[k] = WORD if u_kind[k] == PUNCT and is_word_character(texts[k].as_py()) else u_kind[k]
        u_digit = ints(pc.match_substring_regex(texts, "^[0-9]")).astype(bool)
        u_bad, u_after_c, u_after_b, u_inner = (np.zeros(len(texts), np.int64) for _ in range(4))
        inner = re.compile(r"(?<!\w)(" + "|".join(w for w in self.decisions["python"] if w != "case") + r")(?!\w)", re.ASCII)
        for k in np.flatnonzero((u_kind == STR) | (u_nls > 0)):
            s = texts[k].as_py()
            u_bad[k] = u_kind[k] == STR and (len(s) < 2 or s[-1] != s[0])
            if _F_STRING.match(s):
                u_inner[k] = interpolated_decisions(s, inner)
            tail = s.rsplit("\n", 1)[-1]
            u_after_c[k], u_after_b[k] = len(tail), len(tail.encode())
        t_len, t_bytes, t_nls = ints(pc.utf8_length(trivias)), ints(pc.binary_length(trivias)), ints(pc.count_substring(trivias, "\n"))
        t_after_c, t_after_b = np.zeros(len(trivias), np.int64), np.zeros(len(trivias), np.int64)
        with_nl = np.flatnonzero(t_nls > 0)
        for k in with_nl:
            tail = trivias[k].as_py().rsplit("\n", 1)[-1]
            t_after_c[k], t_after_b[k] = len(tail), len(tail.encode())

        # Languages of the tokens.
        lang = pc.dictionary_encode(b.column("language"))
        names, of = lang.dictionary.to_pylist(), pc.fill_null(lang.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        is_lang = lambda name: of == names.index(name) if name in names else np.zeros(n, bool)
        tid, kind = known[code], u_kind[code]

        def one_of(ids, words):
            member = np.zeros(len(number) + 1, bool)
            member[[number[w] for w in words]] = True
            return member[ids] & (ids > 0)

        dec = np.zeros(n, np.int64)
        for name, words in self.decisions.items():
            if name in names:
                words = [w for w in words if not (name == "python" and w == "case")]
                dec[is_lang(name) & (kind == WORD) & one_of(tid, words)] = 1
        f_string = is_lang("python") & (kind == STR) & (u_inner[code] > 0)
        dec[f_string] = u_inner[code][f_string]
        tnls, nls, clen, blen = t_nls[tcode], u_nls[code], u_len[code], u_bytes[code]
        brk = tnls > 0
        for name, comment in self.indented.items():
            if name in names:                                                # a newline in the trivia that is not a line continuation
                u_brk = np.zeros(len(trivias), bool)
                for k in with_nl:
                    u_brk[k] = re.search(r"(?<!\\)\n", re.sub(re.escape(comment) + "[^\n]*", "", trivias[k].as_py())) is not None
                brk = np.where(is_lang(name), u_brk[tcode], brk)

        # Positions, depths, decisions.
        punct = kind == PUNCT
        is_ = lambda w: tid == number[w]
        step = lambda o, c: np.where(punct & is_(o), 1, np.where(punct & is_(c), -1, 0))
        char_off, byte_off, line = total(t_len[tcode] + clen) - clen, total(t_bytes[tcode] + blen) - blen, total(tnls + nls) - nls
        braces, parens, squares = step("{", "}"), step("(", ")"), step("[", "]")
        adelta = braces + parens + squares
        bdepth, pdepth, adepth, cum_dec = total(braces), total(parens), total(adelta), total(dec)
        newline = latest((nls > 0) | (tnls > 0))
        prev = neighbour(-1)

        def column(off, size, after_text, after_trivia):
            own, mine = off - after_trivia, tnls > 0
            found = np.where(nls > 0, off + size - after_text, own)
            p = np.where(prev >= 0, newline[prev], -1)
            return off - np.where(mine, own, np.where(p >= 0, found[p], 0))

        ccol = column(char_off, clen, u_after_c[code], t_after_c[tcode])
        bcol = column(byte_off, blen, u_after_b[code], t_after_b[tcode])
        ll_brk = brk & (adepth - adelta == 0)
        ll, ll_start = total(ll_brk), (idx == 0) | ll_brk
        end_line, end_bcol = line + nls, np.where(nls > 0, u_after_b[code], bcol + blen)

        # Brackets: the next one of the same path, family and level.
        closes = np.full(n, -1)
        opens = punct & one_of(tid, "{([")
        at = np.flatnonzero(punct & one_of(tid, "{}()[]"))
        if len(at):
            family = np.select([one_of(tid[at], "{}"), one_of(tid[at], "()")], [0, 1], 2)
            sdepth = adepth - bdepth - pdepth
            level = np.choose(family, [bdepth[at], pdepth[at], sdepth[at]]) + ~opens[at]
            order = np.lexsort((at, level, family, group[at]))
            a, z = at[order[:-1]], at[order[1:]]
            same = ((group[a] == group[z]) & (family[order[:-1]] == family[order[1:]]) & (level[order[:-1]] == level[order[1:]]) & opens[a] & ~opens[z])
            closes[a[same]] = z[same]

        # Statements, groups and declarations.
        after = lambda x, none: np.where(prev >= 0, x[prev], none)
        p1, q1 = after(tid, 0), np.where(neighbour(-2) >= 0, tid[neighbour(-2)], 0)
        has_prev = prev >= 0
        is_p = lambda w: has_prev & (p1 == number[w])
        stmt_start = ll_start | ((adepth == 0) & (is_p(";") | (is_p(":") & one_of(tid, ["import", "from"]))))
        stmt = latest(stmt_start)
        groups = {w: latest(is_("(") & is_p(w)) for w in ("import", "type")}
        decl = latest(~has_prev | one_of(p1, ";{}"))

        # A token that cannot stand after the one before it in any Java text.
        digit = u_digit[code]
        pdigit, qdigit = has_prev & after(digit, False), np.where(neighbour(-2) >= 0, digit[neighbour(-2)], False)
        pword, pstr = has_prev & (after(kind, -1) == WORD), has_prev & (after(kind, -1) == STR)
        word, string = kind == WORD, kind == STR
        pin = lambda ws: has_prev & one_of(p1, ws)
        tin = lambda ws: one_of(tid, ws)
        closing, after_literal, literal = tin(";)]}"), pstr | (pword & pdigit), string | (word & digit)
        same_text = has_prev & (code[neighbour(-2)] == code[prev]) & (neighbour(-2) >= 0)
        misfit = ((is_p("=") & (closing | is_(","))) | (is_p(".") & (closing | tin(",=")) & ~qdigit) | (is_p(",") & tin(")],"))
                  | (is_p("(") & tin(",]}")) | (is_p("(") & is_(";") & (q1 != number["for"])) | (is_p("(") & is_(")") & one_of(q1, BEFORE_PARENTHESIS))
                  | (is_p("[") & tin(";,)}")) | (pin("/%^&|!~<?") & closing) | (is_p("*") & tin(")]}")) | (pin("+-") & closing & ~same_text)
                  | (after_literal & (literal | (word & ~is_("instanceof")))) | (pword & ~pdigit & ~pin(BEFORE_LITERAL) & literal)
                  | (pword & pin(BEFORE_PARENTHESIS) & ~is_("(")) | (pword & pin(BEFORE_OPERAND) & tin("=)],."))
                  | (pword & pin(["class", "interface", "enum"]) & tin("{(=") & (q1 != number["."])))
        misnested = opens & np.where(closes >= 0, adepth[closes] + 1 != adepth, True)
        bad = (string & (u_bad[code] > 0)) | misnested | (is_lang("java") & misfit)
        over = lambda f, x: np.repeat(f.reduceat(x, starts), length)
        balanced = ((over(np.minimum, bdepth) >= 0) & (over(np.minimum, pdepth) >= 0) & (bdepth[last] == 0) & (adepth[last] == 0)
                    & (pdepth[last] == 0) & (over(np.maximum, bad.astype(np.int64)) == 0))

        # Only the rows that some extractor reads: logical-line starts, import
        # statements, depth-0 colons, braces and semicolons, string literals,
        # ``name(`` candidates, ``… struct`` names, what follows type parameters and
        # the declaration keywords (with those of languages given as rules).
        nxt = neighbour(1)
        n1 = np.where(nxt >= 0, tid[nxt], 0)
        every = (ll_start | ((stmt >= 0) & one_of(tid[stmt], ["import", "from"])) | (is_(":") & (adepth == 0))
                | (word & tin([*DECLARATION_WORDS, *self.words])) | (punct & tin("{;")) | string | (word & one_of(n1, ["(", "struct"]))
                | (is_("(") & pin("]>")) | (is_("struct") & is_p("]")) | (is_lang("go") & (bdepth == 0) & word & one_of(n1, "[")))
        # Of a built-in language's files fewer will do (where a path has one row, so
        # that token numbers are distinct).  What a lookup finds after its anchor is
        # the first of its kind there: Python's first colon after a header, Java's
        # first stop after a parenthesis, a class or an import.
        seen = lambda flag: after(latest(flag), -1)
        word_of = lambda *w: word & one_of(tid, w)
        colon, stop = is_(":") & (adepth == 0), punct & tin("{;")
        header = ll_start & one_of(tid, ["def", "class", "async"])
        group_o, group_c = groups["import"], np.where(groups["import"] >= 0, closes[groups["import"]], -1)
        own = {
            "python": (ll_start | ((stmt >= 0) & one_of(tid[stmt], ["import", "from"])) | (colon & (seen(header) > seen(colon)))),
            "go": (word_of("func", "type") | (is_("{") & (bdepth == 1)) | (is_("(") & is_p("]"))
                   | (string & (is_p("import") | (q1 == number["import"]) | ((group_o >= 0) & (group_c >= 0) & (here > group_o) & (here < group_c))))
                   | (word & (one_of(n1, ["struct"]) | ((bdepth == 0) & one_of(n1, "[")))) | (is_("struct") & is_p("]"))),
            "java": ((idx == 0) | word_of("class", "import") | (word & one_of(n1, "(") & ~one_of(tid, NOT_CALLED))
                     | (stop & (seen(is_(")")) > seen(stop))) | (is_("{") & (seen(is_("class")) > seen(is_("{")))) | (is_(";") & (seen(is_("import")) > seen(is_(";"))))),
        }
        single = np.bincount(path, minlength=1)[group] == 1
        narrow = {name: is_lang(name) & single for name in own}
        keep = np.select([narrow[x] for x in own], [own[x] for x in own], every)
        # Neighbours, ends and declaration starts where an extractor reads them.
        spec = word & one_of(n1, ["struct", "["])
        declares = header | word_of("func", "type", "class", "import") | spec
        read = {"t1": declares | colon | is_("struct") | word & one_of(n1, "("), "t2": declares, "t3": header | spec, "prev_end": narrow["python"],
                "file_end": header | word_of("func"), "decl_start": narrow["java"] & word & one_of(n1, "(")}
        wide = ~np.any(list(narrow.values()), axis=0)
        k = np.flatnonzero(keep)

        def pick(x, at, kind):
            return pa.array(x[at], kind)

        def words_at(at):
            return texts.take(pa.array(code[at], mask=at < 0))

        kinds = pa.array(_KINDS.tolist(), pa.string())
        i32, i64 = pa.int32(), pa.int64()
        values = {"idx": (idx, i32), "char_off": (char_off, i64), "char_end": (char_off + clen, i64), "line": (line, i32), "ccol": (ccol, i32), "bcol": (bcol, i32),
                  "end_line": (end_line, i32), "end_bcol": (end_bcol, i32), "bdepth": (bdepth, i64), "pdepth": (pdepth, i64), "adepth": (adepth, i64),
                  "dec": (dec, i32), "cum_dec": (cum_dec, i64), "ll": (ll, i64), "ll_start": (ll_start, pa.bool_()), "file_balanced": (balanced, pa.bool_()),
                  "stmt_no": (total(stmt_start), i64)}

        def struct(kind, at, **other):
            """The struct's fields at these places (null where there is none)."""
            cols = []
            for f in kind:
                if f.name in other:
                    cols.append(other[f.name])
                elif f.name == "text":
                    cols.append(words_at(at))
                elif f.name == "kind":
                    cols.append(kinds.take(pa.array(kind_of[at])))
                elif f.name == "close":
                    cols.append(struct(f.type, np.where(at >= 0, closes[at], -1)))
                else:
                    cols.append(pick(*(values[f.name][:1]), at, values[f.name][1]))
            return pa.StructArray.from_arrays(cols, fields=list(kind), mask=pa.array(at < 0))

        kind_of = kind
        def span(at):
            c = np.where(at >= 0, closes[at], -1)
            return pa.StructArray.from_arrays([pa.array(idx[at], i32), pa.array(idx[c], i32, mask=c < 0)], fields=list(self.schema.field("imp_grp").type), mask=pa.array(at < 0))

        type_of = lambda name: self.schema.field(name).type
        where_read = lambda name, at: np.where((wide | read[name])[k], at[k], -1)
        rows = pa.array(row[k])
        out = {"file_path": b.column("file_path").take(rows), "language": b.column("language").take(rows), "content": pa.nulls(len(k), pa.string()), "masked": pa.nulls(len(k), pa.string()),
               "kind": kinds.take(pa.array(kind[k])), "text": words_at(k), "close": struct(type_of("close"), closes[k]),
               "nxt1": words_at(nxt[k]), "prv1": words_at(prev[k]), "prv2": words_at(neighbour(-2)[k]), "pkind1": kinds.take(pa.array(kind[prev[k]], mask=prev[k] < 0)),
               **{f"t{i}": struct(type_of(f"t{i}"), where_read(f"t{i}", neighbour(i))) for i in (1, 2, 3)},
               "prev_end": struct(type_of("prev_end"), where_read("prev_end", prev)), "file_end": struct(type_of("file_end"), where_read("file_end", last)), "stmt": words_at(stmt[k]),
               "imp_grp": span(groups["import"][k]), "typ_grp": span(groups["type"][k]), "decl_start": struct(type_of("decl_start"), where_read("decl_start", decl))}
        java = np.flatnonzero(is_lang("java"))
        fit = np.full(path.max() + 1, -1)
        fit[group[java]] = balanced[java]
        return (pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pick(values[f.name][0], k, f.type) for f in self.schema], schema=self.schema),
                pa.array(fit[path] == 1, mask=fit[path] < 0))


def _sizes(b: pa.RecordBatch) -> np.ndarray:
    """Pieces of each row."""
    return pc.fill_null(pc.list_value_length(b.column("pieces")), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows dealt anew so that all those of a path, which come one after the
    other, are in one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        path = pc.dictionary_encode(b.column("file_path"), null_encoding="encode").indices.to_numpy()
        changes = np.flatnonzero(path[1:] != path[:-1]) + 1
        same = bool(held) and held[-1].column("file_path")[-1].as_py() == b.column("file_path")[0].as_py()
        if held and not same:
            yield _joined(held)
            held = []
        if len(changes):
            yield _joined([*held, b.slice(0, changes[-1])])
            held = []
            b = b.slice(changes[-1])
        held.append(b)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
