"""Splitting, tokens, mixing and encoding repair on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from srcloom.llm import encoding, mixing, splitting, tokens


def test_splits_keep_limits_and_cover():
    rng = random.Random(2)
    for _ in range(80):
        text = "".join(rng.choice(["word ", "\n", "\n\n", "def f():\n", "x" * 70, "é́", "\r\n", "👩‍💻"]) for _ in range(rng.randrange(1, 300)))
        spans = splitting.split_text(text, 200, 40)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for a, b in spans:
            assert 0 < b - a <= 200
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert a < c <= b < d and b - c <= 40
    assert splitting.split_text("") == [] and splitting.split_text("abc") == [(0, 3)]
    assert all(b - a <= 10 for a, b in splitting.split_text("x" * 1000, 10, 3))
    with pytest.raises(ValueError):
        splitting.split_text("x", 5, 5)


def test_split_prefers_blank_lines():
    text = "def a():\n" + "    x = 1\n" * 12 + "\n\n" + "def b():\n" + "    y = 2\n" * 12
    (_, cut), _ = splitting.split_text(text, 200, 0)[:2]
    assert text[cut:].startswith("def b")


def test_split_chunks(spark):
    body = "line\n" * 800
    rows = [("a", 11, body), ("a", 11, body), ("b", 1, "short"), ("c", 1, None), ("d", None, "y" * 1601)]
    df = spark.createDataFrame(rows, "chunk_id string, start_line int, content string").withColumn("piece_no", F.lit("clash"))
    got = splitting.split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {"a", "d"} and max(r.n_chars for r in got) <= 1600
    a = sorted((r for r in got if r.chunk_id == "a"), key=lambda r: r.piece_no)
    assert a[0].start_line == 11 and a[-1].end_line == 811
    for r in a:
        assert r.content == "line\n" * (r.end_line - r.start_line)
    assert splitting.split_oversized(df.limit(0)).isEmpty()


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", " \n\n ", "plain words", "<|endoftext|>", "don't 's a1b2 　x\x85y\x1cz\r\n", "a" * 900, "'" * 40 + "s", "é" * 200 + " １２３" * 20, "naïve 👩‍💻 日本語のテキスト。" * 9]


@pytest.mark.parametrize("leaf", [1, 3, 16, 100])
def test_joined_ids_are_those_of_the_whole(leaf):
    path = tokens.tokenizer_path()
    for t in TEXTS:
        parts = [tokens.Encoded.leaf(path, t[i : i + leaf]) for i in range(0, len(t), leaf)] or [tokens.Encoded("", None, "")]
        assert tokens.fold(path, parts).ids(path) == reference(t)
        assert tokens.encode_text(path, t, leaf).ids(path) == reference(t)
        left = parts[0]
        for p in parts[1:]:
            left = left.join(path, p)
        assert left.ids(path) == reference(t), "joining is associative"


def test_encode(spark):
    texts = [*TEXTS, None, "long " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", leaf=64, spread=500).collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokens.encode(df, "doc_id", leaf=64, spread=500, counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.limit(0), "doc_id").isEmpty()


def test_mixture_meets_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    rng = random.Random(1)
    docs = [(i, s, rng.randrange(1, 50)) for i, s in enumerate(["big"] * 200 + ["small"] * 9 + ["other"] * 30 + [None] * 5)] + [(900, "big", 0), (901, "big", None)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("missing", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(d, t)
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["big"].actual_share - 2 / 3) < 2e-3 and abs(rep["small"].actual_share - 1 / 3) < 2e-3 and rep["missing"].used_tokens == 0
    have = {s: sum(n or 0 for _, x, n in docs if x == s) for s in ("big", "small")}
    rows = chosen.collect()
    for s, cap in (("big", 1), ("small", 4)):
        mine = [r for r in rows if r.source == s]
        assert sum(r.tokens_used for r in mine) == rep[s].budget_tokens <= cap * have[s]
        assert all(r.tokens_used <= cap * r.n_tokens for r in mine) and len({r.doc_id for r in mine}) == len(mine)
        assert sum(r.tokens_used != r.repeats * r.n_tokens for r in mine) <= 1, "one document is cut"
    assert any(rep[s].budget_tokens == c * have[s] for s, c in (("big", 1), ("small", 4))), "as large as the caps allow"
    fixed = {r.source: r.budget_tokens for r in mixing.mix(d, t, total_tokens=90)[1].collect()}
    assert fixed["big"] == 60 and fixed["small"] == 30
    assert mixing.mix(d.limit(0), t)[0].isEmpty()


CLEAN = ["Für die Größe der Häuser müssen wir prüfen, ob das möglich wäre.", "Le résultat n’est pas trié, même après la dernière étape.", "После обновления проверьте, что файл пропал.", "Él dice que la canción está aquí, señor."]


def test_garbled_texts_are_found_and_restored(spark):
    docs, truth = [], {}
    for i in range(240):
        docs.append((i, ["a", "b", None][i % 3], CLEAN[i % 4] + f" {i}"))
    swaps = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "koi8_r"), ("cp1252", "mac_roman"), ("cp1252", "cp850")]
    for k, (w, r) in enumerate(swaps):
        for c in (0, 2) if w == "utf-8" else (0,):
            text = CLEAN[c] + f" {k}"
            try:
                truth[1000 + 10 * k + c] = text
                docs.append((1000 + 10 * k + c, "a", text.encode(w).decode(r)))
            except UnicodeDecodeError:
                del truth[1000 + 10 * k + c]
    docs += [(2000, "b", "lost: F\ufffdr"), (2001, "b", None), (2002, "b", ""), (2003, "b", "plain"), (2004, "b", "½ ² ≈ 1.4 千 한국어 👩‍💻 É È GIÀ")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("run", F.lit("clash"))
    got = {r.doc_id: r for r in encoding.repair(df).collect()}
    assert set(got) == {*truth, 2000}
    assert not got[2000].fully
    restored = sum(got[k].restored == t for k, t in truth.items())
    assert restored >= len(truth) - 1
    assert {r.doc_id for r in encoding.garbled_ids(df).collect()} == set(got)
    assert encoding.repair(df.limit(0)).isEmpty()


WORDS = """после обновления проверьте что файл пропал из каталога сборка завершилась ошибкой потому разбор строки начинается перед запуском нужно удалить старые записи
таблица хранит только последние значения каждого ключа если запрос повторяется сервер возвращает прежний ответ без нового чтения диска модуль читает настройки при старте
затем ждёт сигнала очередь заполняется быстрее чем её успевают разбирать рабочие процессы индекс строится заново когда меняется схема данных""".split()


def test_a_cipher_of_no_listed_page_is_learned(spark):
    """A source written throughout in a page that no table names, and one whose own characters are no cipher."""
    rng = random.Random(3)
    text = lambda words: " ".join(rng.choice(words) for _ in range(25)) + "."
    german = "für die größe der häuser müssen wir prüfen ob das möglich wäre".split()
    greek = "το αρχείο λείπει από τον κατάλογο και πρέπει να ελέγξετε τις ρυθμίσεις πριν ξεκινήσει".split()
    docs = [(i, "abc"[i % 3], text(WORDS if i % 2 else german)) for i in range(260)] + [(5000 + i, "greek", text(greek)) for i in range(40)]
    truth = {1000 + i: text(WORDS) for i in range(60)}
    assert "iso8859_5" not in encoding.READ_AS + encoding.WRITTEN_IN
    docs += [(k, "g", t.encode("iso8859_5").decode("latin-1")) for k, t in truth.items()]
    got = {r.doc_id: r for r in encoding.repair(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert set(got) == set(truth)
    # Letters that occur a handful of times stay unclear.
    right = sum(a == b for k, t in truth.items() for a, b in zip(got[k].restored, t, strict=True))
    assert right >= 0.97 * sum(map(len, truth.values())) and "learned>g" in got[1000].swaps


def test_frequent_phrases_are_no_swaps(spark):
    docs = [(i, "ab"[i % 2], f"La tâche reste bloquée à l’étape {i}. § 3 ¬ 5 £") for i in range(300)] + [(900 + i, "a", f"После шага {i} к пятому файлу.") for i in range(50)]
    assert encoding.repair(spark.createDataFrame(docs, "doc_id long, source string, text string")).isEmpty()
