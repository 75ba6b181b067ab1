"""Assignments of each syntax family, written from small grammars: precision and recall of the spans; long texts are linear."""

import random
import time

import pytest

from larkspur.llm import secret_scan

LETTERS = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
SECRET_WORDS = ("db", "main", "prod", "user"), ("pwd", "passphrase", "credential", "private_key", "signing_key", "password", "client_secret")
PLAIN_WORDS = ("db", "main", "prod", "user"), ("author", "token_count", "compass", "colour", "password_policy", "title", "monkey", "release")
FAMILIES = ("python", "javascript", "java", "c", "go", "yaml", "properties", "shell", "xml", "json")


def styled(words, style):
    if style == "camel":
        return words[0] + "".join(w.capitalize() for w in words[1:])
    return {"snake": "_".join(words), "upper": "_".join(words).upper(), "kebab": "-".join(words), "dot": ".".join(words)}[style]


def statement(rng, family, vocabulary, v):
    """One statement of a family that gives the value v to a name of the vocabulary."""
    first, last = (rng.choice(part) for part in vocabulary)
    words = [first, *last.split("_")]
    snake, camel, upper, kebab, dot = (styled(words, s) for s in ("snake", "camel", "upper", "kebab", "dot"))
    q = rng.choice("\"'")
    forms = {
        "python": [
            f"{snake} = {q}{v}{q}", f'{snake}: str = "{v}"', f'config["{snake}"] = "{v}"', f"os.environ['{upper}'] = '{v}'", f'{snake} = """{v}"""', f'base = "{v}"; {snake} = f"{{base}}"', f'{snake} = (\n    "{v}"\n)',
            f'client.set_{snake}("{v}")', f'a, {snake} = "x", "{v}"', f'connect(host="h", {snake}={q}{v}{q})', f'{snake} = r"{v}"', f'{snake} = ["{v}", "b"]', f'x = b"{v}"\n{snake} = x', f'{snake} = str("{v}")', f'o.{snake} = "{v[:10]}" "{v[10:]}"',
        ],
        "javascript": [
            f"const {camel} = {q}{v}{q};", f'let {camel}: string = "{v}";', f"process.env.{upper} = '{v}'", f"const {camel} = `{v}`;", f"const base = '{v}';\nconst {camel} = `${{base}}`;", f'{{ {camel}: "{v}" }}', f"settings['{camel}'] = \"{v}\"", f'api.set{camel[0].upper()}{camel[1:]}("{v}")',
            f'{camel}: ["{v}", "b"]', f'const base = "{v}"; const {camel} = "" + base;',
        ],
        "java": [f'private static final String {upper} = "{v}";', f'props.setProperty("{dot}", "{v}");', f'builder.with{camel[0].upper()}{camel[1:]}("{v}")', f'String {camel} = new String("{v}");', f'map.put("{snake}", "{v}");', f'String x = "{v}";\nthis.{camel} = x;'],
        "c": [f'#define {upper} "{v}"', f'#  define {upper} "{v}"', f'const char *{snake} = "{v}";', f'char {snake}[] = "{v}";', f'setenv("{upper}", "{v}", 1);', f'cfg->{snake} = "{v[:9]}" "{v[9:]}";'],
        "go": [f'{camel} := "{v}"', f"const {camel} = `{v}`", f'user, {camel} := "root", "{v}"', f'os.Setenv("{upper}", "{v}")', f'Config{{{camel}: "{v}"}}'],
        "yaml": [f"{snake}: {v}", f"{kebab}: '{v}'", f"{snake}:\n  {v}", f'{snake}:\n  "{v}"', f"{snake}: |\n  {v}", f"{snake}: >-\n  {v}", f"base: {v}\n{snake}: ${{base}}", f"{snake}s:\n  - {v}\n  - b" if not last.endswith("d") and vocabulary is PLAIN_WORDS else f"{snake}:\n  - {v}", f'{snake}: ["{v}"]'],
        "properties": [f"{dot}={v}", f"{dot} = {v}", f"{upper}={v}", f"{kebab} = \"{v}\"", f"base={v}\n{dot}=${{base}}"],
        "shell": [f"export {upper}={v}", f"{upper}='{v}'", f"tool --{kebab} {v}", f"tool --{kebab}={v}", f"ENV {upper} {v}", f"ENV {upper}={v}", f"BASE={v}\nexport {upper}=\"${{BASE}}\"", f"setenv {upper} {v}"],
        "xml": [f"<{kebab}>{v}</{kebab}>", f'<setting name="{snake}" value="{v}"/>', f"<add key='{dot}' value='{v}' />", f'<entry key="{dot}">{v}</entry>', f'<string name="{snake}">{v}</string>', f'<db host="h" {camel}="{v}"/>', f'<property\n  name="{dot}"\n  value="{v}"/>'],
        "json": [f'{{"{snake}": "{v}"}}', f'{{"{camel}":"{v}","n":1}}', f'{{"{snake}": ["{v}", "b"]}}', f'{{"a": {{"{kebab}": "{v}"}}}}', f'{{"{snake}":\n  "{v}"}}'],
    }
    return rng.choice(forms[family])


@pytest.mark.parametrize("family", FAMILIES)
def test_precision_and_recall_by_family(family):
    rng = random.Random(family)
    hit = missed = false = 0
    for i in range(600):
        v = "".join(rng.choice(LETTERS) for _ in range(15)) + "7" + "".join(rng.choice(LETTERS) for _ in range(4))
        secret = i % 2 == 0
        text = f"the secret of words\n{statement(rng, family, SECRET_WORDS if secret else PLAIN_WORDS, v)}\nand after"
        spans = secret_scan.spans(text)
        found = any(a < text.rindex(v[-6:]) + 6 <= b and text[a:b].strip() for _, a, b in spans)
        hit, missed, false = hit + (secret and found), missed + (secret and not found), false + (not secret and bool(spans))
    assert hit / (hit + missed) >= 0.95 and hit / (hit + false) >= 0.95, (hit, missed, false)


V = "q8Zr2mK9xLpV0wT4"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f'config["db_password"] = "{V}"', [V]), (f"os.environ['SECRET_KEY'] = '{V}'", [V]), (f'pwd = """{V}"""', [V]), (f'base = "{V}"; pwd = f"{{base}}"', [V]), (f"base: {V}\npwd: ${{base}}", [V]), (f'<setting name="pwd" value="{V}"/>', [V]),
        (f"passphrase:\n  {V}", [V]), (f'db_pwd = (\n  "{V}"\n)', [V]), (f'client.set_password("{V}")', [V]), (f'#define PWD "{V}"', [V]), (f'a, pwd = "x", "{V}"', [V]), (f'{{"pwd": ["{V}", "{V[::-1]}"]}}', [V, V[::-1]]),
        (f'pwd, a = "x", "{V}"', []), (f'f(a, pwd="x", b="{V}")', []), (f'pwd = f"{{unknown}}"\nauthor = "{V}"', []), (f'secret = getpass("{V} enter it")', []), (f"Password:\n{V} is what they said", []), (f'base = "{V}"\ncolour = f"{{base}}"  # token', []),
        (f'pwd = "x" if y else None\ntitle = ["{V}"]', []),
    ],
)
def test_forms(text, found):
    assert [text[a:b] for k, a, b in secret_scan.spans(text) if k == "literal"] == found


@pytest.mark.parametrize(
    "text",
    [
        "\\\"" * 300_000 + "pwd=", "pwd = (" * 100_000, "pwd = [\"a\", " * 60_000, "a, " * 200_000 + "pwd = 1", "a,b=1;" * 100_000 + "pwd", "<a \"" * 200_000 + "pwd", "<a b='" * 100_000 + "pwd", "pwd:\n- a1:\n" + "- a1:\n" * 100_000, "pwd:\n" + "- a1\n" * 100_000,
        "f(" * 300_000 + "pwd", "pwd = '''" * 50_000, "pwd = \"\"\"\\\"\"\"" * 50_000, "a[a" * 200_000 + "] pwd", "x[y]" * 200_000 + " pwd = ", "pwd = ${a" * 100_000, "pwd = f\"{a" + "{a" * 200_000, "--pwd " * 100_000, "ENV pwd " * 100_000, "pwd = str(" * 80_000, " " * 1_000_000 + "pwd=", "pwd =" + "\\\n" * 300_000,
        "pwd = 'a" * 100_000, "pwd:\n  " * 100_000,
    ],
)
def test_long_texts_are_lexed_in_linear_time(text):
    began = time.perf_counter()
    secret_scan.spans(text)
    assert time.perf_counter() - began < 8
