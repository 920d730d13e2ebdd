import pytest

from cairn.llm.residue import assess, find_residue
from tests.llm import residue_texts as texts

RESIDUE = [
    ("404 Not Found\nThe page you asked for may have been moved or deleted.\n© host.example", "error"),
    ("Home | Index | Help - Page not found - Requested resource: /page/790", "error"),
    ("<html><head><title>500 Internal Server Error</title></head><body><h1>500 Internal Server Error</h1></body></html>", "error"),
    ("お探しのページは存在しません\nトップページへ戻る", "error"),
    ("Zeitüberschreitung - Vorgang ea39085c - Bitte später erneut versuchen.", "error"),
    ('Traceback (most recent call last):\n  File "render.py", line 569, in show\nKeyError: \'title\'', "error"),
    ("Title\n\nPlease enable JavaScript\nCookies must be allowed as well.", "script"),
    ("<noscript>You need JavaScript to view this page</noscript>", "script"),
    ("Cette page nécessite JavaScript Chargement…", "script"),
    ("${year} has ${date} inhabitants and belongs to ${year}.\n\nReplace this paragraph with a description of the subject.", "template"),
    ("人口は__概要__人（__国名__現在）。\nここに本文を入力してください。", "template"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
    ("name\n\n" + "abc" * 30, "filler"),
    ("sample text " * 20, "filler"),
    ("Title\n\n" + "-=" * 40, "filler"),
]
REAL = [
    "A notice asked visitors to enable JavaScript before the bias would open. The matrix was split into 194 folds and one fold was left out.",
    "Readers met the message “404 not found” for 84 days after the list moved. It lies 12 km south of the sea, close to the mill.",
    "Usage: rank_pages -d DIR [-o <file>] < logs.txt\n\n  --min=${MIN}       drop a guild seen fewer than ${MIN} times\n  -n {count}         keep the best {count} of every portal\n",
    "雛形では{{項目名}}と書いた箇所に分類が入る。\n各項目は最も近い記事と比較され、静かなものが残される。北側には古い橋があり、南側には市場が並んでいる。",
    "TODO: write introduction\n\nThe guild sold 766 pieces of cloth to the page every autumn. Before 1779 nobody had weighed the page against the stone.",
    "```\nprint('%(name)s' % row)\n404 not found\n```\nThe code above prints the name of each row, which the reader can check by hand.",
    "x, x, river!\n" * 8,
    "name\tfold\t150\nname\terror\t359\nname\tcolour\t249",
    "The mill was rebuilt in 1809 and kept its name. Its wheel is older than the river." + "ー" * 30,
]


@pytest.mark.parametrize(("text", "kind"), RESIDUE)
def test_residue(text, kind):
    assert assess(text)[0] == kind


@pytest.mark.parametrize("text", [*REAL, "", "   ", None, "?????", "A heading of some words\n" + "=" * 40 + "\n\nThe guild sold 766 pieces of cloth."])
def test_real_text(text):
    assert assess(text) == (None, 0.0)


def test_find_residue(spark):
    rows = [(1, RESIDUE[0][0], "k"), (1, RESIDUE[0][0], "k"), (2, REAL[0], "k"), (None, None, "k"), (3, REAL[0] * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = sorted(find_residue(df, "doc_id", "text").collect(), key=str)
    assert sorted((r["doc_id"] or 0, r["kind"]) for r in got if r["kind"]) == [(1, "error"), (1, "error")] and len(got) == 5
    assert find_residue(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("lang", sorted(texts.REAL))
def test_texts_made_by_hand(lang):
    kept = [t for t in texts.REAL[lang] if assess(t)[0] is None]
    found = [t for t in texts.RESIDUE[lang] if assess(t)[0]]
    assert len(texts.REAL[lang]) >= 50 and len(texts.RESIDUE[lang]) >= 50
    assert len(found) >= 0.95 * len(texts.RESIDUE[lang])
    assert len(texts.REAL[lang]) - len(kept) <= 0.05 * len(found)


def test_odd_letters_meet_every_pattern():
    assert assess("404 Not Found – the requeſted page does not exiſt.")[0] == "error"


def test_long_placeholder_names():
    assert assess("{{" + "very long field name " * 20 + "}}")[0] == "template"
