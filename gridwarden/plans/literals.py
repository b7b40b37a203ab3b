"""Values that a query and its SQL share."""

CUTS = [33.371, 90.137, 260.713]  # metres, between the distances that occur

# Offence texts as literals of two names, and by number what they must read as.
LITERALS = [
    ("['{a}',]", "{A}"), ('("{a}","{b}")', "('{A}', '{B}')"), ('["{a}", None]', "{A}|NONE"),
    ("'{a}' \"{b}\"", "{A}{B}"), ("'{a}'", "{A}"), ("['{a}' '{b}', \"{a}\"]", "{A}{B}|{A}"),
    ("'{a}', '{b}'", "('{A}', '{B}')"), ('("{a}",)', "('{A}',)"), ("(\t'{a}'\n)", "{A}"),
    ("[{a}, {b}]", "[{A}, {B}]"), ("['{a}', +5, True]", "{A}|5|TRUE"), ("['{a}\\'s', \"{b}\"]", "{A}'S|{B}"),
    ("[ ]", "[]"), ("(\"{a}'s\", '{b}')", "(\"{A}'S\", '{B}')"), ("['{a}', ['{b}']]", "['{A}', ['{B}']]"),
    ("['{a}' 5]", "['{A}' 5]"), ("( )", "()"), ("['{a}'", "['{A}'"), ("'{a}' '{b}', ", "('{A}{B}',)"),
]
