"""Texts that every operator meets: null, empty, blank, one word, odd characters, repeats, very long ones."""

ODD = [None, "", " \t\n ", "word", "\x1c!\x1c !", "é ß İ   中文 😀", "a a a a a a a a", "line\nline\nline", "x" * 5000, "ab " * 40000, "word"]
