"""Tables with the odd rows that every operator must take."""

LONG = "\n".join(f"line {i} of a very long text with number {i * 7919 % 1000}" for i in range(3000))
TEXTS = [
    (0, "Released under the MIT License.\nOne two three four five six seven."),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Übergrößen kosten mehr, sagt der Händler; naïve café 日本語 <|endoftext|> ok"),
    (5, LONG),
    (6, "Released under the MIT License.\nOne two three four five six seven."),
    (7, "mail a.b@example.com or +1 (319) 555-5132 from 10.0.0.1, card 4111 1111 1111 1111"),
    (8, "a"),
    (9, "12 34 ###"),
    (9, "12 34 ###"),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (-4, "negative ids are ids\r\nwith a second line"),
    (1 << 40, "far away\n\n\nthe end"),
    (11, "don't  DO   that's  it'll İstanbul ΣΣ \x1c\x85 x"),
]


def odd_documents(spark):
    """Columns of ``documents`` and others whose names operators use inside."""
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}", len(t or ""), "x", k, "y", "z", b"b") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, content string, digest string, sig binary",
    )


def no_documents(spark):
    return odd_documents(spark).filter("false")
