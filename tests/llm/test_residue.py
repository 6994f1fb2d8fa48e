from biblion.llm.residue import is_sentence, segments, slots, template_residue, without_residue


def test_segments():
    assert segments("<h1>404 Not Found</h1>") == ["# not found"]
    assert segments("A title\n\nOne. Two 7.", "A title") == ["one.", "two #."] and is_sentence("one.") and not is_sentence("# not found")
    assert segments("asdf asdf asdf jkl\nLorem ipsum dolor sit amet.") == ["~ ~ ~."]
    assert [x[:2] for x in slots("By {{Author}} on ____ in <b> and [Your Name Here].")] == [("mustache", "author"), ("blank", ""), ("angle", "b"), ("your", "name")]
    assert slots("plain text") == [] and slots("") == []


def corpus():
    prose = ["The trial enrolled patients with stroke. ", "Calibration drifted after the update. ", "Consent forms named the tool in passing. ", "Nurses read the alerts at night. ", "The model was frozen in spring. "]
    rows = [(i, "".join(prose[(i + j) % 5] for j in range(1 + i % 5)) + f"Case {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} was odd in its own way.", f"T{i}") for i in range(60)]
    styles = ["{{%s}}", "${%s}", "<<%s>>", "@@%s@@"]
    names = ["title", "author", "journal", "date"]
    rows += [(100 + i, f"This article by {styles[i % 4] % names[i // 4]} examines {styles[(i + 1) % 4] % names[(i + 1) % 4]} in brief.", None) for i in range(16)]
    rows += [(150, "This article by ____ examines nothing in brief.", None)]
    rows += [(200 + i, f"Study {i} of wards. The prompt uses fields such as {{{{title}}}} and we measured them. " + prose[i % 5], None) for i in range(8)]
    heads = ["404 Not Found", "502 Bad Gateway", "Error 410", "Status 500"]
    rows += [(300 + i, f"{heads[i % 4]}\nThis page is {['gone', 'moved', 'blocked'][i % 3]}.{' Go back to the start.' * (i % 2)}", None) for i in range(12)]
    rows += [(330, "A title of a work\n\nThis page is blocked.", "A title of a work"), (302 + 100, None, None), (303 + 100, "", None)]
    rows += [(404 + 100, "Of the links we checked, many returned an error page such as 404 Not Found. " + "".join(prose), None), (300, "404 Not Found\nThis page is gone.", None)]
    return rows


def test_corpus(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], "doc_id long, text string, title string, kind int")
    got = {r.doc_id: r.kind for r in template_residue(docs).collect()}
    assert {i for i in got if 100 <= i < 200} == {*range(100, 116), 150}
    assert {i for i in got if 300 <= i < 400} == {*range(300, 312), 330} and got[300] == "page"
    assert not any(i < 100 or 200 <= i < 300 or i in (402, 403, 504) for i in got)
    assert without_residue(docs).columns == docs.columns and without_residue(docs).where("doc_id = 402").count() == 1
    assert template_residue(docs.limit(0)).count() == 0
    # Without repetition there are no page templates.
    assert {r.kind for r in template_residue(docs, min_pages=10**6).collect()} == {"field"}
