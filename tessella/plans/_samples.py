"""Short texts that reach every branch of the text rules; queries cross them with the keys of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.plans import _sql as Q


def pick(texts: Sequence[str], number: Column) -> Column:
    """The text of a number, in turn."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(number, F.lit(len(texts))) + 1).cast("int"))


def pick_sql(texts: Sequence[str], number: str) -> str:
    return f"([{', '.join(map(Q.text, texts))}][({number}) % {len(texts)} + 1])"


PERSONA = [
    "", "mệt và stress vì deadline, burnout", "debug the api on docker with sql and cache", "hello", "git push to the server, compile the class", "tôi buồn, mất ngủ, cần tâm sự",
    "plain words only", "hey, the server has a crash before the deadline", "code",
]

QUESTIONS = [
    "hi", "why? how? when? where", "docker kubernetes and sql sharding", "react css dom redux", "binary search on a heap, dijkstra", "lstm gan clustering regression",
    "quantum entropy of a wave", "ethics of therapy and culture", "something rather vague " * 11, "tell me of a nice day", "sql react",
]

ENTITIES = [
    "How does React Native use camelCaseNames and snake_case_words over HTTP", "Explain Docker Compose", "tại sao nginx chậm", "JSON and XML, json_parse_all of Json", "Is Go ok",
    "Tell Alice Smith about alice smith and useEffectHook", "a b c d",
]

HEADS = [
    "# Deep learning for all\nTopic: neural nets\nA first sentence that says much. Another one! Is this the third one? And a fourth one follows.\n", "## Deploy\nabout: docker and terraform\nShort. Tiny. ",
    "subject: sorting a tree\n### Graph search\n", "proof of a theorem. The equation of probability.\n", "no rule fits these words here. ", "về: mạng nơ-ron\n# Kubernetes on a cloud\n",
]

BLOCKS = [
    "# t\n```js\nconst x = 12; // a line of code here\n```\nend", "```\n#include <vector>\nstd::vector<int> v;\n```\nand\n```\npublic class A { void f() {} }\n```",
    "```\ndef f(x):\n    return x + 1 # more\n```", "```\nlet total = items.map(x => x + 1);\n```\n```sh\nls\n```", "```\necho hello | grep h > out.txt\n```", "```\nx = 1\n```\nint add(int a, int b) { return a + b; }",
    "function twice(n) { return 2 * n; } and def f(x) { import y }", "no code at all", "```\nmov ax, bx ; add ax, 12\n```",
]

MANUALS = [
    "# Tar\n- Pack a folder of track files\n```bash\ntar czf track.tgz example\n```\nmore\n```\nls\n```\n", "intro\n\n## Show an example\n```\ncat readme\n```\nafter\n", "```sh\necho track\n```\n* Track twice\n```sh\ntrack --example 1\n```\n```sh\n\n```",
    "nothing to run here", "# A\n```python\nprint(1)\n```\nfar\nfar\nfar\nfar\nexample",
]

CODE = [
    ("javascript", "// adds\nfunction add(a, b) {\n  if (a && b) {\n    return a + b;\n  }\n  return 0; // key KEY;\n}"),
    ("javascript", "var x = 'one';\ntry { f(x) } catch (e) {}\nconsole.log(x);\nconst password = 'hunter2hunter2';\nquery('SELECT * FROM t WHERE id = ${x}');\neval('x');\n// TODO: tidy KEY\n"),
    ("javascript", "async function f() {\n  await g(10, 20, 30, 40, 50);\n  for (;;) { if (a) { while (b) { do { switch (c) { case 1: [1, (2)] } } while (d); } } }\n  return a||b ? 1 : 2;\n}\n/* a block\n of notes\n*/\n"),
    ("python", "# notes KEY\ndef f(a):\n    \"\"\"doc\"\"\"\n    if a and not b:\n        for x in a:\n            while x:\n                with y as z:\n                    assert z or x\n    elif c:\n        return 1\n    else:\n        return 2\n"),
    ("java", "class A {\n  /* one */\n  int f(int a) {\n    if (a > 1) { return 1; } else if (a < 0) { return 2; }\n    try { g(); } catch (Exception e) { h(KEY); }\n    return 3;\n  }\n}"),
    ("c", "int main() {\n  for (int i = 0; i < 99; i++) {\n    if (i&&j) { printf(\"%d\", KEY); }\n  }\n  return 0;\n}"),
    ("cpp", "// a\n// b\n// c\nint f() { try { throw 1; } catch (int) { } }"),
    ("csharp", "class A { void F() { switch (x) { case 1: break; case 2: break; default: throw new E(KEY); } } }"),
    ("go", "func f() {\n\tselect {\n\tcase <-a:\n\t}\n\tfor x := range y { if x > 1 { return } else { go g() } }\n}"),
    ("rust", "fn f() -> i32 {\n  loop { match x { Some(y) => y?, None => break } }\n  let t = \"a rather long line of code that repeats\";\n  let t = \"a rather long line of code that repeats\";\n  let t = \"a rather long line of code that repeats\";\n  let t = \"a rather long line of code that repeats\";\n  let t = \"a rather long line of code that repeats\";\n  0\n}"),
    ("javascript", "{ // opens\n" + "step(1);\n" * 104 + "if (a) b();\n" * 45 + "}"),
    ("javascript", "let ok = 1;"),
]

LOGS = [
    "request timeout 30s", "OOM killed", "all good", "HTTP 401 unauthorized", "rate limit hit", "ECONNRESET by peer", "FATAL exit", "connect ETIMEDOUT", "429 too many", "out of memory while timeout",
    "403 forbidden", "uncaughtException in worker",
]

AUDITED = [
    "let safe = 1;", "eval (x); exec('ls'); child_process", "el.innerHTML = x; document.write (y)", "password = 'a' and api_key = \"b\"", "SELECT a FROM t WHERE id = ' + id", "see http://example.org and http://example.com",
    "document.write(x)", "execSync ('a')",
]

JOBS = [
    "Senior Backend Developer (remote)", "Retail store manager", "Node.js intern, real estate", "Data entry clerk", "Cloud infrastructure lead", "Cyber analyst with python", "Gardener",
    "Apiary keeper", "Full-stack programming, kubernetes",
]

NAMES = [
    "Express middleware", "Ansible and grafana", "Sharding", "Raft consensus", "Binary heap", "TLS latency", "BERT embedding", "CSRF injection", "Kotlin compiler", "Monolith caching", "Lambda on aws",
    "Calculus", "Optics", "Anthropology", "Watercolours", "Optics of consciousness", "",
]
CATEGORIES = ["Backend", "DevOps", "Database", "AI", "Math", "Algorithms", "Security", "Networking", "System Design", "Cloud", "Physics", "Social", "Other"]

URLS = [
    "https://github.com/a/b", "https://youtube.com/watch?v=1", "https://youtu.be/1", "https://arxiv.org/abs/1", "https://stackoverflow.com/q/1", "https://example.org/github", "HTTPS://GITHUB.COM/a/b ",
]

PAGES = [
    "", "<h2 class='a'>Part &amp; whole</h2><p>See <a href=\"https://a.example/x\">this <b>one</b></a> and <em>that</em>.</p>", "<ul><li>first</li>\n<li>second <code>x &lt; y</code></li></ul><br/><h3>End</h3>",
    "<nav>skip</nav><pre><code>let a = 1;\nlet b = 2;</code></pre><p>done</p><script>evil()</script>", "<h1>Top</h1><strong>bold</strong> <i>slanted</i><img src='a.png'/>",
]
