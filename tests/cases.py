"""Small inputs: logs, reports and source files."""

LOGS = [
    ("py", 'Traceback (most recent call last):\n  File "/w/run.py", line 10, in run\n    go()\n  File "/w/pkg/main.py", line 5, in go\n    x = y\nNameError: name \'y\' is not defined', "/w"),
    ("js", "TypeError: boom\n    at load (/w/src/app.ts:12:7)\n    at main (/w/src/main.js:3:1)", "/w"),
    ("gcc", "main.c:10:5: error: expected ';' before '}'", "/w"),
    ("tsc", "src/a.ts(10,5): error TS2307: Cannot find module 'foo'", "/w"),
    ("rust", "error[E0425]: cannot find value `x` in this scope\n --> src/main.rs:5:10", "/w"),
    ("pytest", "FAILED test_a.py::test_b - AssertionError: expected 5", "/w"),
    ("direct", "SyntaxError: invalid syntax (calc.py, line 42)", "/w"),
    ("npm", "npm ERR! code 1\nnpm ERR! failed to build\nsee log", "/w"),
    ("blank", "", "/w"),
]
REPORTS = [
    ("ok", "3 passed in 0.10s", 0),
    ("bad", "FAILED t/test_a.py::test_x - assert 3 == 4\nERROR t/test_b.py\n1 failed, 1 error, 2 passed, 1 skipped in 0.2s", 1),
    ("jest", "Tests:       1 failed, 1 skipped, 4 passed, 6 total", 1),
    ("none", "", 5),
]
FILES = [
    ("app.py", "import os\nfrom utils import tidy\n\nLIMIT = 3\n\n\nclass Shop:\n    def sell(self, n):\n        return tidy(n)\n\n\n@cache\ndef main():\n    return Shop().sell(LIMIT)\n"),
    ("utils.py", "import re\n\n\ndef tidy(x):\n    return re.sub('a', 'b', str(x))\n"),
    ("web/view.js", "import { a } from './a'\nconst b = require('b')\n\nfunction show(x) {\n  const y = x\n  return y\n}\nclass View {\n}\n"),
]
LONG_FILE = ("long.py", "def big(n):\n    total = 0\n" + "".join(f"    if n > {k}:\n" + "".join(f"        total += {j}\n" for j in range(50)) + f"    n -= {k}\n" for k in range(5)) + "    return total\n")
