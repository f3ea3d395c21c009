import hashlib
import re

from vellum.llm import secrets_scan as X

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in X.op1_secrets(spark, sf).collect():
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{X.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("lexed")] == [s for s in joined.split(",") if s]


def test_failing_matches_consume_their_text():
    t = "password=abc password=abcdef AKIA123 token : 'x' " + "f" * 23 + " " + "f" * 24
    assert [s for s in X.spans_of(t) if s[1] < 3] == base_spans(t)


def test_lexer_pairs_joins_and_propagates():
    t = 'seed_value = "Zx81-kQ99_p2Lm"\ndb_password = seed_value\nlabel = "just a label"\n"clientSecret": "aB3dE5gH" + "9jK2mN4p"\ncount = 12'
    found = [t[a:b] for a, b in X.lexed(t)]
    assert found == ["Zx81-kQ99_p2Lm", "aB3dE5gH", "9jK2mN4p"]
    assert X.lexed("password = changeme\nname: value\nx == y") == []
    assert X.lexed('secret = "aB3dE5gH9jK2"\nsecret += tail') == [(10, 22)]


def test_positions_are_code_points():
    t = "ééé𝄞 token=abcdef99"
    assert X.spans_of(t)[0][0] == 5


def test_redaction_joins_overlaps():
    t = 'a token = "' + "0123456789abcdef" * 2 + '" z'
    assert X.redacted(t) == 'a [ASSIGN]" z'
    assert X.redacted("clean") == "clean"


def test_long_runs_take_linear_time():
    X.spans_of("a" * 300_000 + "= " + "_" * 300_000 + ":" + "b." * 100_000)


def test_awkward_rows(awkward, nothing):
    got = {r.doc_id: r for r in X.scan(awkward).collect()}
    assert got[3].secrets == [] and got[4].secrets == [] and got[10].secrets and {s.kind for s in got[11].secrets} == {"access", "hex"}
    assert got[0].spans == "clash"
    texts = {r.doc_id: r.text for r in X.redact(awkward).collect()}
    assert texts[4] is None and texts[3] == "" and "abcdefgh" not in texts[10]
    assert X.scan(nothing).count() == 0 and X.redact(nothing).count() == 0


def test_literals_are_scored_whole():
    literal = "a" * 300 + "Zx81-kQ99_p2Lm"
    assert [X.lexed(f'{name} = "{literal}"') for name in ("credential", "passphrase")] == [[(14, 14 + len(literal))]] * 2
    assert X.lexed('credential = "' + "a" * 314 + '"') == []


def test_any_number_of_blanks_beside_operators():
    t = "passphrase" + " " * 100 + "=" + "\t" * 100 + '"aB3dE5gH"' + " " * 100 + "+" + " " * 100 + '"9jK2mN4p"'
    assert [t[a:b] for a, b in X.lexed(t)] == ["aB3dE5gH", "9jK2mN4p"]
    X.spans_of(("name" + " " * 1000) * 1000)


VALUE = "aB3dE5gH9jK2mN4p"
#: Hand-labelled lines that assign the credential VALUE to a sensitive name.
HOLD = [
    f'db_password: str = "{VALUE}"', f'password = u"{VALUE}"', f'secret = rb"{VALUE}"', f"<password>{VALUE}</password>", f'const apiSecret: string = "{VALUE}"',
    f'let api_secret: Option<&str> = "{VALUE}"', f'private static final String DB_PASSWORD = "{VALUE}";', f"password := `{VALUE}`", f'"clientSecret": "{VALUE}",',
    f"os.environ['DB_PASSWORD'] = '{VALUE}'", f"export API_SECRET={VALUE}", f"--db-credential={VALUE}", f'#define API_SECRET "{VALUE}"', f"define('DB_PASSWORD', '{VALUE}');",
    f'<add key="ApiSecret" value="{VALUE}"/>', f"<entry key='db.password'>{VALUE}</entry>", f'char passwd[] = "{VALUE}";', f"api_secret: {VALUE}", f'$password = "{VALUE}";', f'passphrase => "{VALUE}"',
    f'def connect(password: str = "{VALUE}"):', f'SECRET ||= "{VALUE}"', f"secret = '''{VALUE}'''", f'x = "{VALUE}"\ny = x\npassword = y', f'dsn = "user=me; password={VALUE}"',
]
#: Hand-labelled lines without a credential.
CLEAN = [
    'password = os.environ["PW"]', "password = getpass()", "password: string;", "const secret: string = load(name)", "password = config.db1.password", "secret: ${DB_SECRET}", 'token = "{{ token }}"',
    'password = "changeme"', "password: str", "if password == other_password:", "passwords = []", "The password: it must be long and never written down.", "token: null", "secret = None",
    "<password></password>", "<password>${db.password}</password>", 'max_tokens = 4096', 'tokenizer = "bpe32k-Uncased"', "api_key = settings.API_KEY", 'password = ""', "password_length: 16", 'secret_name = "x"',
    'label = "a3F5k9Lm2Qp8Zt1W"', "checksum: 9f86d081884c7d65", "key = value",
]


def test_hand_labelled_lines():
    assert [t for t in HOLD if VALUE not in [t[a:b] for a, b in X.lexed(t)]] == []
    assert [t for t in CLEAN if X.lexed(t)] == []  # false positives: 0 of 25
    whole = "\n".join(HOLD + CLEAN)
    assert [whole[a:b] for a, b in X.lexed(whole)].count(VALUE) >= len(HOLD)


def test_propagation_equals_expansion():
    """Names expanded to plain strings, in a small language of joins, give the same spans and scores."""
    import random

    rng = random.Random(3)
    for _ in range(200):
        values, spans, text = {}, {}, ""
        for k in range(12):
            name = rng.choice(["a", "b", "c", "d"]) if k < 11 else "credential"
            parts, got, at = [], "", set()
            for _ in range(rng.randint(1, 3)):
                if values and rng.random() < 0.5:
                    n = rng.choice(sorted(values))
                    parts.append(n)
                    got, at = got + values[n], at | spans[n]
                else:
                    literal = "".join(rng.choice("aB3-xY7") for _ in range(rng.randint(1, 6)))
                    start = len(f"{text}{name} = {' + '.join([*parts, chr(34)])}")
                    parts.append(f'"{literal}"')
                    got, at = got + literal, at | {(start, start + len(literal))}
            text += f"{name} = {' + '.join(parts)}\n"
            values[name], spans[name] = got, at
        want = sorted(spans["credential"]) if X.name_score("credential") + X.literal_score(values["credential"]) >= X.PASSES else []
        assert X.lexed(text) == want, text


def test_doubling_names_take_little_memory():
    import tracemalloc

    t = f'v0 = "{VALUE}"\n' + "".join(f"v{k + 1} = v{k} + v{k}\n" for k in range(60)) + "secret = v60"
    tracemalloc.start()
    assert [t[a:b] for a, b in X.lexed(t)] == [VALUE]
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_hostile_texts_take_linear_time():
    for part in ("a:b[", "a='''", "a=\"b='", "<a ", "a" + " " * 50, 'a="\\"', "a-", 'a"', "a:b<", "a=1+b1=2+", "a: b|"):
        X.spans_of(part * (200_000 // len(part)))
