"""Encoding, packing and template residue."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import encode, packing, residue

TEXTS = ["", None, " ", "Hello world, it's 3 o'clock", "\n\n a\tb  c \r\n", "<|endoftext|> x", "日本語。テスト 👩‍🔬 ok", "naïve  café x​y", "\x1f a \x1cb\x85c", "Привет мир,слово", "a" * 5000, "word " * 20_000, "'S 'Re I'll we'd", "1969, 2½ x²"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(encode.vocabulary())
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_whole_text(spark, plain):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string").withColumn("ids_", F.lit(1))
    got = {r.i: r.ids for r in encode.encode(df).collect()}
    assert got == {i: plain.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    counts = {r.i: r.n_tokens for r in encode.token_counts(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_random_texts_cut_into_pieces(plain):
    r = random.Random(1)
    alphabet = "ab Z\n\t\r.,'’-0½ éßЖжя日本。、「ー　 ​́\x1f😀 \"("
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    pieces = encode._Pieces(encode.vocabulary())
    import numpy as np

    for t, b in zip(texts, pieces.ids(texts)):
        assert np.frombuffer(b, np.int32).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is not None], "i long, text string")
    back = {r.i: r.text for r in encode.decode(encode.encode(df)).collect()}
    assert back == {i: t for i, t in enumerate(TEXTS) if t is not None}


def test_decoding_split_characters_and_nulls(spark, plain):
    ids = plain.encode("😀", add_special_tokens=False).ids
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "i long, ids array<int>")
    got = {r.i: r.text for r in encode.decode(df).collect()}
    assert got[1] == "😀" and "�" in got[2] and got[3] == "" and got[4] is None


def test_offsets_point_at_characters(spark):
    text = "é 😀x"
    rows = encode.offsets(spark.createDataFrame([(1, text), (2, None), (3, "")], "i long, text string"), "i").orderBy("position").collect()
    assert {r.i for r in rows} == {1} and rows[0].start == 0 and rows[-1].end == len(text)
    assert all(0 <= r.start < r.end <= len(text) for r in rows)


def test_empty_table(spark):
    e = spark.createDataFrame([], "i long, text string")
    assert encode.encode(e).count() == 0 and encode.token_counts(e).count() == 0 and encode.decode(encode.encode(e)).count() == 0


def _check_packing(rows, sizes, capacity):
    fill, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r.container] += r.size
        parts[r.item].append((r.part, r.start, r.size))
    assert max(fill.values(), default=0) <= capacity
    for i, s in sizes.items():
        got = sorted(parts.pop(i, []))
        if not s:
            assert not got
            continue
        assert [p for p, _, _ in got] == list(range(len(got))) and sum(z for _, _, z in got) == s
        assert [a for _, a, _ in got] == [sum(z for _, _, z in got[:k]) for k in range(len(got))]
        assert (len(got) > 1) == (s > capacity)
    assert not parts
    return fill


@pytest.mark.parametrize("most_open, splits", [(64, 1), (4, 5), (1, 3)])
def test_packing_is_complete_and_tight(spark, most_open, splits):
    r = random.Random(8)
    sizes = {i: r.choice([0, 1, 5, 100, 100, r.randrange(1, 60), 250, 100 * r.randrange(1, 4)]) for i in range(1500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n long").repartition(splits)
    fill = _check_packing(packing.pack(df, "doc_id", "n", 100, most_open).collect(), sizes, 100)
    if most_open >= 4:
        assert sum(fill.values()) / (100 * len(fill)) > 0.95


def test_packing_merges_leftovers(spark):
    df = spark.createDataFrame([(i, 10) for i in range(40)], "doc_id long, n long").repartition(8)
    assert packing.pack(df, "doc_id", "n", 100).select("container").distinct().count() <= 5


def test_packing_nulls_names_and_nothing(spark):
    df = spark.createDataFrame([(None, 5), (1, None), (2, -1), (3, 0), (4, 7)], "container long, n long")
    assert [(r.item, r.size) for r in packing.pack(df, "container", "n", 10).collect()] == [(4, 7)]
    assert packing.pack(df.limit(0), "container", "n", 10).count() == 0
    assert packing.pack(spark.createDataFrame([("a", 25)], "i string, n long"), "i", "n", 10).count() == 3


SLOTS = [
    "Dear {{first_name}}, your order is here.", "Price: ${price}", "By %%author%%", "[Your date here]", "Title goes here", "TODO: write the summary", "(insert date) The dock reads on.",
    "TBD – company to follow from the editor", "Updated <SUMMARY>", "Read more: &lt;title&gt;", "__company__", "«price»", "$page.title$", "Welcome back, [name]!", "Hallo {% site_name %}, hier", "[hier datum einfügen]", "(aquí va city)",
    "Enter a  image alt  for this section", "<type the city>", "You have {$item.count} new messages.",
]
MESSAGES = [
    "404 Not Found", "Home | News | Login\n\n500 Internal Server Error\nThe server met an unexpected condition and gave up on your request.\n© 2019 x.example", "Please enable JavaScript to view this page.", "Sorry, no content without JS!",
    "HTTP​404.​The​page​you​asked​for​could​not​be​found.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Magna aliqua.", "Movie\nVelit quam elit orci nibh. Magna tempor sit lorem.", "blah blah, blah. blah blah, blah.",
    "请启用 JavaScript 后刷新此页。", "Seite nicht gefunden", "The address /a/b1.htm does not exist on this server.\nRay 9ba918d4", "This is a demo post; edit or delete it, then begin writing.",
]
CONTENT = [
    "The engine reads `{{product}}` and prints the value of the engraving in its place.", "Wer eine Vorlage wie „[[NAME]]“ baut, sollte die Felder vor dem Druck füllen.", "Let S = {x, y, z}; then [x] is the class of x and <x, y> an ordered pair.",
    "    <h1>{{ image_alt }}</h1>\n    {% for w in words %} {{ w }} {% endfor %}\nThe listing above is what the chapter on templates takes apart.", "In shell, `${HOME}/bin` and `$PATH` are expanded before the drought starts.",
    'A placeholder is a promise: the editor writes "title goes here", and the oven keeps the room free.', "A folio was not found in the ledger of 1961, and an error in the count was corrected by hand.",
    'Our handler answers with a 404 when the row is gone; the sentence "page not found" is kept in a table.', "To switch JavaScript on, open the settings, choose Site permissions and tick the second box.",
    'Printers set "lorem ipsum" on trial sheets because nobody stops to read it.', "<b>Bold</b> and <i>plain</i> words in a sentence of the page itself.", None, "", " \n\t ", "Room 404 is on the fourth floor, next to the casserole.",
]


@pytest.mark.parametrize("text", SLOTS)
def test_slots(text):
    assert residue.classify(text)[0] == "slot"
    assert residue.classify("The ship left the port in the morning. " * 30 + text)[0] == "slot"


@pytest.mark.parametrize("text", MESSAGES)
def test_messages_alone(text):
    assert residue.classify(text)[0] == "message"
    assert residue.classify(text + "\nThe ship left the port in the morning, and nobody on the quay had seen the captain since the day before.")[0] is None


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert residue.classify(text)[0] is None


def test_soft_rests_count_when_they_recur(spark):
    rows = [(i, f"s{i % 2}", "Loading...") for i in range(3)] + [(10, "s0", "Redirecting in 5 seconds"), (11, "s0", None), (12, None, "404 Not Found"), (13, "s1", "Plain content of a page that says something of its own.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.flagged(df).collect()} == {0, 1, 2, 12}
    got = {r.doc_id: (r.kind, r.n_texts, r.n_sources, r.residue) for r in residue.judge(df).collect()}
    assert got[0] == ("soft", 3, 2, True) and got[10] == ("soft", 1, 1, False)


def test_long_text_and_empty_table(spark):
    assert residue.classify("The ship left the port. " * 100_000 + "{{title}}")[0] == "slot"
    assert residue.classify("lorem ipsum dolor sit amet. " * 20_000)[0] == "message"
    assert residue.flagged(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_unlisted_wordings_count_when_they_recur_widely(spark):
    notice = "Our apologies: the gadget service failed, retry in {} minutes; an error was logged."
    odd = "Zum grünen Kranze, bitte Platz nehmen und den Wirt rufen."
    rows = [(i, f"s{i % 4}", notice.format(i)) for i in range(6)]
    rows += [(100 + i, f"s{i % 4}", odd) for i in range(12)]
    # copies of content, in fewer texts than everywhere; a notice in unlisted wording that stands alone
    rows += [(200 + i, f"s{i % 4}", "The ship left the port in the morning, and nobody saw the captain.") for i in range(6)]
    rows += [(300, "s1", "The lift has failed; an error was logged, retry later.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.flagged(df).collect()} == {*range(6), *range(100, 112)}
    assert {r.kind for r in residue.judge(df).filter("doc_id >= 100 and doc_id < 200").collect()} == {"text"}


def test_noise_is_judged_by_share_of_the_whole_text():
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit. " * 100
    noise = " ".join(f"\nzork{c}.quib({c}) in vexl{c}" for c in "abcdefgh")
    assert len(residue._letters(noise)) > 60
    assert residue.classify(filler + noise + "\n" + filler)[0] == "message"
    # as much noise alone, or a sentence of the page's own, is content
    assert residue.classify("404 Not Found" + noise)[0] is None
    sentence = "The ship left the port in the morning, and nobody on the quay had seen the captain since the day before."
    assert residue.classify(filler + sentence + " " + filler)[0] is None


def test_headings_and_footers_go_by_position_and_recurrence(spark):
    head, foot = "The Old Harbour Museum of Clocks, Bells and Nautical Instruments of the Northern Coast", "All rights reserved by the trustees of the museum and its friends"
    said = ["The ship left the port in the morning.", "Nobody on the quay had seen the captain.", "A folio was found in the ledger of the mill.", "The oven keeps the room free of damp."]
    rows = [(i, "a", f"{head}\n{t * 3}\n{foot}") for i, t in enumerate(said)]
    rows += [(10, "a", f"{head}\n404 Not Found\n{foot}"), (11, "a", f"404 Not Found\n{foot}")]
    # the same lines are no heading or footer where they don't recur
    rows += [(20, "b", f"{head}\n404 Not Found\n{foot}")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.flagged(df).collect()} == {10, 11}


def _kinds(texts):
    return [residue.read(t)[0] for t in texts]


def test_wordings_that_are_no_rule():
    """Recall and precision over wordings that were written apart from the rules; the last set by itself."""
    from tests.llm import wordings as w

    for messages, slots, content in ((w.MESSAGES, w.SLOTS, w.CONTENT), (w.LAST_MESSAGES, w.LAST_SLOTS, w.LAST_CONTENT)):
        found = sum(k in ("message", "slot") for k in _kinds(messages)) + sum(k == "slot" for k in _kinds(slots))
        false = sum(k in ("message", "slot") for k in _kinds(content))
        assert found >= 0.75 * (len(messages) + len(slots)) and found >= 0.9 * (found + false), (found, false)
    found = sum(k in ("message", "slot") for k in _kinds(w.MESSAGES + w.SLOTS))
    assert found >= 0.9 * len(w.MESSAGES + w.SLOTS)


@pytest.mark.parametrize("times", [1, 2, 15, 40])
def test_verdicts_do_not_depend_on_length(times):
    """Repeated in one line, line by line, and amid navigation: the verdict stays."""
    notice = "Unsupported browser: JavaScript required."
    content = "The ship left the port in the morning, and nobody on the quay had seen the captain."
    nav = "Home | News | Login\n" * times
    for text, kind in ((notice, "message"), (content, None), ("Dear {{first_name}}, welcome.", "slot")):
        for t in (" ".join([text] * times), "\n".join([text] * times), nav + text + "\n" + nav):
            assert residue.classify(t)[0] == kind


@pytest.mark.parametrize("n", [5, 30, 300, 3000])
def test_quotations_and_listings_of_any_length(n):
    filler = "of a ship and a harbour, " * n
    assert residue.classify(f'The editor wrote "Dear {filler}{{{{first_name}}}} and so on" and left it at that for the day.')[0] is None
    assert residue.classify(f"The editor wrote „Dear {filler}{{{{first_name}}}} and so on“ and left it at that for the day.")[0] is None
    assert residue.classify(f"The engine reads `{filler}{{{{first_name}}}}` and prints what it finds in the place of it.")[0] is None
    assert residue.classify("The listing shows a loop.\n{% for w in words %}" + f"{filler}{{{{ w }}}}\n" + "{% endfor %}\nIt is what the chapter takes apart.")[0] is None
    assert residue.classify(f"{filler} Dear {{{{first_name}}}}, your order is here.")[0] == "slot"


def test_sentences_that_recur_need_less_of_their_wording(spark):
    """A notice with unknown words, in other company each time, is found by grouping its sentences; the same standing once is not."""
    odd = "The gizmo server unit of the quibble denied access to several user accounts."
    rows = [(i, f"s{i % 4}", f"{odd}\nReference {i}a{i}. {x}") for i, x in enumerate(["Please wait.", "Try again later.", "404 Not Found", "Contact the webmaster.", "Reload the page.", "Go back."])]
    rows += [(50, "s1", "The gadget server part of the quibble denied access to several user accounts.")]
    assert residue.read(odd)[0] == "loose"
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.flagged(df).collect()} == set(range(6))
    assert {r.kind for r in residue.judge(df).filter("doc_id < 6").collect()} <= {"loose", "message"}


def test_many_unclosed_blocks_take_linear_time():
    assert residue.classify("{% for x in y %} text " * 20_000)[0] is None


def test_vocabulary_with_other_words_is_encoded_whole(spark):
    """A second public vocabulary, and a byte-level one whose words may hold line breaks: no pieces, the library's own ids."""
    assert encode.cuts_are_sure(encode.vocabulary())
    other = encode.vocabulary("word_bpe_49k.json")
    assert not encode.cuts_are_sure(other)
    tok = Tokenizer.from_file(other)
    tok.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    assert {r.i: r.ids for r in encode.encode(df, path=other).collect()} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("change", [{"use_regex": False}, {"add_prefix_space": True}, None])
def test_changed_pre_tokenizers_are_noticed(spark, tmp_path, change):
    import json

    with open(encode.vocabulary(), encoding="utf-8") as f:
        data = json.load(f)
    if change is None:
        data["normalizer"] = {"type": "Lowercase"}
    else:
        data["pre_tokenizer"] = {**data["pre_tokenizer"], **change}
    path = str(tmp_path / f"changed-{list(change or ['n'])[0]}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f)
    assert not encode.cuts_are_sure(path)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["One line\nand another", "two  words", "日本。語"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert {r.i: r.ids for r in encode.encode(df, path=path).collect()} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


@pytest.mark.parametrize("merge", [2, 3, 64])
def test_packing_merges_in_rounds(spark, merge):
    """Leftovers of many tasks meet, whatever the number that meet at once."""
    sizes = {i: 7 + i % 9 for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n long").repartition(11)
    fill = _check_packing(packing.pack(df, "doc_id", "n", 100, 4, merge).collect(), sizes, 100)
    assert sum(fill.values()) / (100 * len(fill)) > 0.93
