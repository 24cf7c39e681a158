DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    return df


def texts():
    """Texts with the hard cases: null, empty, blanks only, long, repeated, other scripts."""
    return [
        None,
        "",
        " \n\t ",
        "a",
        "It's  two  spaces\n\nand lines \r\n end ",
        " no-break space\x00nul <|endoftext|> \x1c x",
        "日本語 текст  éà 😀",
        "word " * 3000,
        "x" * 20000,
        "same text here",
        "same text here",
    ]
