"""Random files made of pieces that rules look for, and of rare white space."""

import random

from lintlake.plans.corpus import CODE, PATHS

PIECES = [
    "eval(", "new Function(", "x?.", "auth", "token = '", "'", '"', "password: \"", "console.",
    "log(", "TODO", "hack:", " 123 ", "45", "\t", "     ", "\u00a0", "\u2003", "\f", "\r", "if (",
    "{", "}", ")", "SELECT ", "${", "+", "exec(", "`", "DEBUG=true", "debug: true", "cors(", "DES ",
    "Mode = ECB", "hashlib.md5(", "yaml.load(", ".then(f(", "catch (e) {", "a" * 20, "/*", "*/",
    "//", "process.env.AUTH || '", "PRIVATE KEY-----", "-----BEGIN ", "async (", "await ",
    "import { ", "} from 'x'", "else if (x) {", "if (x) {", "ALLOWED_ORIGINS = '*'", ".innerHTML=",
    "function f(", "try {", "throw e;", "\u00e9", ";", ",", "name", " as ", "def g(): ", "return ",
]


def random_files(count: int = 300, seed: int = 3) -> list[tuple[str, str]]:
    """(path, content) pairs: the corpus' pieces of code, and random lines."""
    rng = random.Random(seed)
    rows = [(f"{a}{i}{b}", code) for i, (code, (a, b)) in enumerate(zip(CODE, PATHS * 2))]
    for i in range(count):
        a, b = rng.choice(PATHS[:20])
        lines = [
            "".join(rng.choices(PIECES, k=rng.randint(1, 8))) for _ in range(rng.choice([8, 70]))
        ]
        rows.append((f"{a}{i}{b}", "\n".join(lines)))
    return rows
