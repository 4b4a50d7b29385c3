"""Whole results of operators that SQL can't state, against plain Python; texts of over a megabyte; ties."""

import functools
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ligature.llm import lang_id, media, packing, pieces, quality, queries, segments, sp_codec, token_counts, tokens

from .conftest import prose

MARK = "▁"


@pytest.fixture(scope="module")
def long_(spark):
    """A text of over a megabyte, a part of it as a text of its own, a copy of that part, and short ones."""
    whole = "\n".join(prose(k, 90) + f" numéro {k} 🙂" for k in range(1700))
    assert len(whole.encode()) > 1_000_000
    texts = [(1, whole), (2, whole[400_000:420_000]), (3, whole[400_000:420_000]), (4, prose(5000, 60)), (5, None), (6, "")]
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


# 1


def ways(word, ids, unknown, longest):
    """All segmentations of a word with its mark, as lists of piece ids."""
    if not word:
        return [[]]
    out = []
    for n in range(1, min(len(word), longest) + 1):
        k = ids.get(word[:n], unknown if n == 1 else None)
        if k is not None:
            out += [[k, *rest] for rest in ways(word[n:], ids, unknown, longest)]
    return out


class ByEnumeration:
    """The stated model, fitted and applied by listing every segmentation of every word."""

    def __init__(self, labelled):
        vocabulary, t = pieces.load(pieces.default_path()), segments.table(pieces.default_path())
        self.ids = {w: k for k, w in enumerate(vocabulary.ids)}
        self.size, self.unknown, self.longest, self.lists = t.size, t.unknown, t.longest, {}
        self.languages = sorted({k for _, k in labelled})
        counts = {k: Counter() for k in self.languages}
        for text, k in set(labelled):
            counts[k].update(self.words(text))
        start = [1.0 / self.size] * self.size
        start[t.none] = 0.0
        self.p = {k: start for k in self.languages}
        for _ in range(lang_id.ROUNDS):
            sums = {k: self.expect(counts[k], self.p[k]) for k in self.languages}
            lone = self.ids[MARK]
            mark = sum(sums[k][lone] / sum(sums[k]) for k in self.languages) / len(self.languages)
            for k in self.languages:
                total = sum(sums[k]) - sums[k][lone]
                new = [(1 - lang_id.FLOOR - mark) * n / total + lang_id.FLOOR / (self.size - 2) for n in sums[k]]
                new[lone], new[t.none] = max(mark, lang_id.FLOOR / self.size), 0.0
                self.p[k] = new

    @staticmethod
    def words(text):
        runs, run = [], ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                run += c
            elif run:
                runs.append(run)
                run = ""
        return Counter(runs)

    def listed(self, word):
        if word not in self.lists:
            self.lists[word] = ways(MARK + word, self.ids, self.unknown, self.longest)
        return self.lists[word]

    def expect(self, counts, p):
        out = [0.0] * self.size
        for word, n in counts.items():
            weights = [math.prod(p[k] for k in way) for way in self.listed(word)]
            whole = math.fsum(weights)
            for way, x in zip(self.listed(word), weights, strict=True):
                for k in way:
                    out[k] += n * x / whole
        return out

    def posterior(self, text):
        counts = self.words(text)
        if not counts:
            return lang_id.UNDETERMINED, 0.0
        logs = [sum(n * math.log(math.fsum(math.prod(self.p[k][i] for i in way) for way in self.listed(w))) for w, n in counts.items()) for k in self.languages]
        temper = min(1.0, lang_id.SCORE_WORDS / sum(counts.values()))
        parts = [math.exp((x - max(logs)) * temper) for x in logs]
        best = parts.index(max(parts))
        return self.languages[best], 1.0 / math.fsum(parts)


def test_languages_equal_enumeration_of_all_segmentations(spark):
    """Piece probabilities, languages and scores of a whole table, fitted and scored by listing all segmentations."""
    samples = {"aa": ["the river runs to the sea", "stones in the river bed", "we see the tide rise"], "bb": ["der fluss zieht zum meer", "steine liegen im fluss", "wir sehen die flut über"], "cc": ["日本 の 海", "川 の 石"]}
    asked = ["the stones rise", "die steine", "川 海 日本", "2 ½ Ⅻ ²", "", None, "fluss river", "Ünter dem Meer see", "zz qq", "ſea x̌y ab1cd", "日本 the"]
    labelled = [(t, k) for k, ts in samples.items() for t in ts]
    rows, i = [], 0
    free = iter(x for x in range(10_000) if zlib.crc32(str(x).encode()) % 4 != 2)
    held = iter(x for x in range(10_000) if zlib.crc32(str(x).encode()) % 4 == 2)
    rows = [(next(free), t, k) for t, k in labelled] + [(next(free), *labelled[0]), (next(free), "no language here", None)]
    rows += [(next(held), t, "aa") for t in asked]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ByEnumeration(labelled)
    fitted = lang_id.fit(docs.where(~lang_id.held_out(docs.doc_id)))
    assert fitted.languages == model.languages
    for j, k in enumerate(model.languages):
        assert fitted.p[:, j] == pytest.approx(model.p[k], rel=1e-9)
    got = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        name, score = model.posterior(t)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (name, zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["score"] == pytest.approx(score, rel=1e-9)


def test_equal_languages_tie_by_name(spark):
    docs = spark.createDataFrame([(i, "same words here", k) for i, k in ((0, "zz"), (1, "mm"), (3, "zz"), (4, "mm"), (5, "mm"), (7, "zz"))], "doc_id long, text string, lang string")
    labelled = docs.where(~lang_id.held_out(docs.doc_id))
    assert {r["lang"] for r in labelled.collect()} == {"mm", "zz"}
    assert {(r["lang_pred"], r["score"]) for r in lang_id.identify(docs).collect()} == {("mm", 0.5)}


# 4


@functools.cache
def tokenizer_and_names():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer, {k: w for w, k in tokenizer.get_vocab().items()}


def shares(text, starts, rule):
    """(section, start, end, tokens, crossing) by going through the letters of each token."""
    tokenizer, names = tokenizer_and_names()
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    section, at, begin = [], 0, set(starts)
    for k in range(len(text)):
        section.append(section[-1] + (k in begin) if section else 0)
    n, crossing = Counter(), Counter()
    for k in tokenizer.encode(text, add_special_tokens=False).ids if text else []:
        letters = sorted(set(owner[at : at + len(names[k])]))
        at += len(names[k])
        held = Counter(section[c] for c in letters)
        most = max(held.values())
        to = {"start": min(held), "end": max(held), "majority": min(s for s, x in held.items() if x == most)}[rule]
        n[to] += 1
        crossing[to] += len(held) > 1
    assert at == len(owner)
    ends = [*sorted(begin - {0}), len(text)]
    return [(s, b, e, n[s], crossing[s]) for s, (b, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]


def lines(text):
    return [0, *(k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text))]


COLUMNS = ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_letters_counted_one_by_one(odd, rule):
    """Every section of every odd text, by its lines and by starts that cut words, letters and tokens apart."""
    got = Counter(rows_of(token_counts.attribute(odd, rule=rule), *COLUMNS))
    expect = Counter((i, *s) for i, t in rows_of(odd, "doc_id", "text") for s in shares(t or "", lines(t or ""), rule))
    assert got == expect
    rng, rows = random.Random(4), []
    for i, t in rows_of(odd, "doc_id", "text"):
        cuts = sorted(rng.sample(range(1, len(t)), min(len(t) // 3, 40))) if t and len(t) > 3 else []
        rows.append((i, t, [*cuts, *cuts[:2], -1, 0, 10**7]))
    docs = odd.sparkSession.createDataFrame(rows, "doc_id long, text string, cuts array<int>")
    got = Counter(rows_of(token_counts.attribute(docs, rule=rule, starts="cuts"), *COLUMNS))
    assert got == Counter((i, *s) for i, t, c in rows for s in shares(t or "", [x for x in c if 0 < x < len(t or "")], rule))
    assert sum(n for (*_, crossing), n in got.items() if crossing) > 0


# 5


@functools.cache
def worst_and_longest():
    v = pieces.load(pieces.default_path())
    return min(s for s in v.scores.values() if s > -1e8) - 10, max(map(len, v.ids))


def best_pieces(v, text):
    """(ids, score) of the best segmentation of marked text by a plain table; letters outside become byte pieces."""
    worst, longest = worst_and_longest()
    best, took = [0.0], [0]
    for e in range(1, len(text) + 1):
        top, by = -math.inf, 0
        for n in range(min(longest, e), 0, -1):
            piece = text[e - n : e]
            s = worst if n == 1 and (piece not in v.ids) else v.scores.get(piece)
            if s is not None and best[e - n] + s > top:
                top, by = best[e - n] + s, n
        best.append(top)
        took.append(by)
    ids, e = [], len(text)
    while e:
        piece = text[e - took[e] : e]
        letter = MARK if piece == "\udc81" else piece
        ids.append([v.ids[piece]] if piece in v.ids else [v.bytes_[b] for b in letter.encode()])
        e -= took[e]
    return [k for part in ids[::-1] for k in part], best[-1]


def marked(text):
    return MARK + text.replace(MARK, "\udc81").replace(" ", MARK)


def test_pieces_equal_a_plain_table(odd):
    """Ids of all odd texts, with other scripts, byte pieces, marks in the text, runs of spaces and ties."""
    v, c = pieces.load(pieces.default_path()), sp_codec.codec(pieces.default_path())
    more = ["  two  spaces  ", "▁ ▁▁ a▁b", "naïve café — Ωmega", "한국어 텍스트", "\x00\x01\ttabs\r\n", "🙂🙂🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "l" * 333, "𝔘𝔫𝔦", "------------------------------------ ====", prose(3, 2500)]
    texts = [t for _, t in rows_of(odd, "doc_id", "text") if t] + more
    bytes_seen = 0
    for t, got in zip(texts, c.encode(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        expect = [k for chunk in re.findall(f"{MARK}+[^{MARK}]*", marked(t)) for k in best_pieces(v, chunk)[0]]
        assert ids == expect
        bytes_seen += sum(k in v.byte_of for k in ids)
        # No segmentation over the places between chunks is better.
        whole, score = best_pieces(v, marked(t))
        apart = math.fsum(best_pieces(v, chunk)[1] for chunk in re.findall(f"{MARK}+[^{MARK}]*", marked(t)))
        assert apart == pytest.approx(score)
        assert len(whole) == len(ids) or score == pytest.approx(apart)
    assert bytes_seen > 20


# 10


def test_stored_sound_is_read_by_another_reader(odd, tmp_path):
    """Members are sound files to the standard reader; features counted sample by sample, and nothing is lost."""
    stored = media.store(odd, str(tmp_path / "sound"))
    seen = Counter()
    for i, n, body in rows_of(stored, "doc_id", "n_bytes", "media"):
        with wave.open(io.BytesIO(body)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE)
            frames = w.readframes(w.getnframes())
        assert len(frames) % 192 == 0 and len(frames) > 0 and set(frames[n:]) <= {32}
        seen[i, frames[:n].decode()] += 1
        level, mean = [x - 128 for x in frames], sum(frames) / len(frames) - 128
        low = [x < mean for x in level]
        crossings = sum(a != b for a, b in zip(low, low[1:], strict=False))
        loudest = Counter(x // 16 for x in frames)
        busiest = min(k for k, x in loudest.items() if x == max(loudest.values()))
        expect = f"rms={math.sqrt(sum(x * x for x in level) / len(level)):.4f};crossings={1000 * crossings // len(level)};level={busiest}"
        assert media.feature(np.frombuffer(frames, np.uint8)) == expect
    assert seen == Counter((i, t or "") for i, t in rows_of(odd, "doc_id", "text"))
    described = media.described(stored).collect()
    assert {(r["media_bytes"] - r["payload_bytes"], r["error"]) for r in described} == {(44, None)}


# Texts of over a megabyte


#: The SQL of op11 lists all pairs of equal words of a text, and that of op2 copies its words for each window, too much
#: for a long one; test_repeats has long texts of op11, and op2 is counted below.
LONG_SQL = sorted(set(queries.oracle_sql()) - {"op11_periodic_runs", "op2_adaptive_quality"})


@pytest.mark.parametrize("name", LONG_SQL)
def test_long_texts_equal_the_sql(spark, long_, tmp_path, name):
    long_.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    got = queries.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(result.fetchall())


def test_measures_of_long_texts(long_):
    got = {r["doc_id"]: r for r in quality.rules(long_).collect()}
    for i, t in rows_of(long_, "doc_id", "text"):
        word = re.compile(r"[^\x20\x09-\x0D]+")
        words, rows = word.findall(t or ""), [x for x in (t or "").split("\n") if word.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen = Counter(windows)
        repeated = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(5)}
        expect = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(rows) - len(set(rows)), len(repeated))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expect
        assert got[i]["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def test_long_texts_are_coded_whole(long_):
    """Sections, pieces and sequences of a text of over a megabyte hold all of it."""
    texts = dict(rows_of(long_, "doc_id", "text"))
    code = tokens.coder(tokens.default_path())
    sections = rows_of(token_counts.attribute(long_), "doc_id", "start", "end", "n_tokens")
    for i, t in texts.items():
        mine = sorted((a, b) for k, a, b, _ in sections if k == i)
        assert "".join((t or "")[a:b] for a, b in mine) == (t or "")
        assert sum(n for k, *_, n in sections if k == i) == len(code.encode(t))
    coded = {r["doc_id"]: r for r in sp_codec.digests(long_).collect()}
    assert all(r["round_trip"] for r in coded.values())
    at = texts[1].index(" ", 600_000)
    apart = sp_codec.codec(pieces.default_path()).encode([texts[1][:at], texts[1][at + 1 :]])
    assert coded[1]["n_pieces"] == sum(map(len, apart)) // 4
    packed = rows_of(packing.pack(long_), "doc_id", "start", "length")
    for i, t in texts.items():
        ends = sorted((s, s + n) for k, s, n in packed if k == i)
        assert [s for s, _ in ends] == [0, *(e for _, e in ends[:-1])] and ends[-1][1] == len(code.encode(t)) + 1
