from tessera.llm import density

BODY = "".join(f"<p>Sentence {k} of the article, long enough to count as running text on a page.</p>" for k in range(6))
TEXT = "\n".join(f"Sentence {k} of the article, long enough to count as running text on a page." for k in range(6))


def test_form_around_the_body():
    page = f"<body><form><div><label>Search</label><input><select><option>one</option></select>{BODY}</div></form></body>"
    assert density.extract(page) == TEXT
    assert density.extract(page.replace("</body>", "<p>Outside.</p></body>")).startswith(TEXT)
    assert density.extract(f"<body><form><fieldset><legend>All</legend>{BODY}</fieldset></form></body>") == TEXT


def test_small_form_is_left_out():
    assert density.extract(f"<body><article>{BODY}<form><p>Your mail address please</p><input></form></article></body>") == TEXT


def test_link_list_in_article_stays():
    refs = '<ul><li><a href="/1">Reference one by its author</a></li><li><a href="/2">Reference two by its author</a></li></ul>'
    assert density.extract(f"<body><article>{BODY}{refs}</article></body>") == TEXT + "\nReference one by its author\nReference two by its author"
    marked = refs.replace("<ul>", '<ul class="related">')
    assert density.extract(f"<body><article>{BODY}{marked}</article></body>") == TEXT
