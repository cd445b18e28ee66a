"""URL functions as column expressions.

Addresses are read as browsers do: blanks around them, tabs and line ends go; a backslash is a slash in http
addresses and any number of slashes may follow the scheme; hosts may be percent-encoded or international, which
become Punycode; a path keeps what it may hold and the rest is percent-encoded; parameters are decoded and
encoded again as a form is sent. An address that a browser refuses has an empty host and path, and no canonical
form. Of hosts in numbers only the usual four decimal ones and IPv6 in brackets are read; others are refused.
Letters of hosts are lower-cased, not normalised otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.columns import fields, let, trim

#: Suffixes of more than one label, tracking parameters and extensions of assets.
MULTI_PART = ("co.uk", "org.uk", "ac.uk", "gov.uk", "co.in", "net.in", "org.in", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.sg", "com.my", "co.za", "com.mx")
TRACKING = r"(?i)^(utm_|fbclid|gclid|msclkid|mc_cid|mc_eid|ref|_hs|igshid|yclid)"
ASSET = r"(?i)\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|zip|gz|rar|mp4|webm|mp3|wav|woff2?|ttf|eot|dmg|exe|pkg|csv|xlsx?|docx?|pptx?)$"
#: Schemes whose addresses have a host, their ports, and ASCII characters in the order of names in dictionaries.
SPECIAL = "https?|wss?|ftp"
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
COLLATED = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789abcdefghijklmnopqrstuvwxyz"
#: The same places in ASCII order.
_PLACES = "".join(chr(33 + i) for i in range(len(COLLATED)))
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Addresses that need none of the care below.
PLAIN = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z][a-z-]*(?:/[A-Za-z0-9_~!$&'()*+,;=:@-]+(?:\.[A-Za-z0-9_~!$&'()*+,;=:@-]+)*)*/?(?:\?[^#\s]*)?(?:#[^\s]*)?$"
#: Characters that no host may hold, and those that a path keeps.
HOST_REFUSED = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
PATH_ENCODED = r"[\x00-\x20\"#<>?`{}^\x7F]|[^\x00-\x7F]"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _decoded(text: Column) -> Column:
    """Percent escapes as UTF-8; a percent sign that begins none stays."""
    whole = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.url_decode(whole)).otherwise(text)


def punycode(label: Column) -> Column:
    """A host label of any letters as ASCII, after RFC 3492. Letters beyond the first plane count as they are."""
    points = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint"))
    return let(fields(points=points, basic=F.regexp_replace(label, r"[^\x00-\x7F]", "")), lambda x: _punycode(x["points"], x["basic"]))


def _punycode(points: Column, basic: Column) -> Column:
    zero = F.lit(0).cast("bigint")

    def digits(delta: Column, bias: Column) -> Column:
        """A number in the digits of the code, whose weights follow the bias."""
        start = fields(q=delta, out=F.lit(""), more=F.lit(True))

        def step(s: Column, k: Column) -> Column:
            def going(t: Column) -> Column:
                last = s["q"] < t
                digit = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (36 - t))
                shown = F.substring(F.lit(_LOWER + "0123456789"), (digit + 1).cast("int"), F.lit(1))
                return fields(q=F.when(last, zero).otherwise(F.floor((s["q"] - t) / (36 - t))), out=F.concat(s["out"], shown), more=~last)

            return F.when(s["more"], let(F.greatest(F.lit(1), F.least(F.lit(26), k * 36 - bias)).cast("bigint"), going)).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)["out"]

    def adapted(delta: Column, first: Column, done: Column) -> Column:
        scaled = let(F.floor(delta / F.when(first, 700).otherwise(2)), lambda d: d + F.floor(d / (done + 1)))
        start = fields(d=scaled, k=zero)

        def step(s: Column, _: Column) -> Column:
            return F.when(s["d"] > 455, fields(d=F.floor(s["d"] / 35), k=s["k"] + 36)).otherwise(s)

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step), lambda end: end["k"] + F.floor(36 * end["d"] / (end["d"] + 38)))

    def state(n, delta, bias, done, out):
        return fields(n=n, delta=delta, bias=bias, done=done, out=out)

    def each_point(s: Column, m: Column) -> Column:
        """All letters of one code point; those below it only move the counter on."""
        ahead = state(m, s["delta"] + (m - s["n"]) * (s["done"] + 1), s["bias"], s["done"], s["out"])

        def letter(r: Column, c: Column) -> Column:
            met = state(r["n"], zero, adapted(r["delta"], r["done"] == F.char_length(basic), r["done"]), r["done"] + 1, F.concat(r["out"], digits(r["delta"], r["bias"])))
            passed = state(r["n"], r["delta"] + 1, r["bias"], r["done"], r["out"])
            return F.when(c == r["n"], met).when(c < r["n"], passed).otherwise(r)

        return let(F.aggregate(points, ahead, letter), lambda end: state(end["n"] + 1, end["delta"] + 1, end["bias"], end["done"], end["out"]))

    start = state(F.lit(128).cast("bigint"), zero, F.lit(72).cast("bigint"), F.char_length(basic).cast("bigint"), F.concat(basic, F.when(basic != "", "-").otherwise("")))
    foreign = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= 128)))
    return F.concat(F.lit("xn--"), F.aggregate(foreign, start, each_point)["out"])


def _host(raw: Column) -> Column:
    """A host as browsers show it; empty where they refuse it."""
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    six = F.when(raw.rlike(r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"), F.lower(raw)).otherwise("")

    def checked(name: Column) -> Column:
        number = name.rlike(r"(^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?$") & ~name.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
        return F.when((name == "") | name.rlike(HOST_REFUSED) | number, "").otherwise(name)

    def ascii(name: Column) -> Column:
        labels = F.transform(F.split(name, r"\."), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), punycode(x)).otherwise(x))
        return F.when(name.rlike(r"[^\x00-\x7F]"), F.array_join(labels, ".")).otherwise(name)

    named = let(let(F.lower(F.translate(_decoded(raw), "。．｡", "...")), ascii), checked)
    return F.when(raw.startswith("["), six).otherwise(named)


def _segments(path: Column) -> Column:
    """The path without its dot segments, which may be written by escapes."""
    start = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up, here = x["p"].rlike(r"(?i)^(\.|%2e){2}$"), x["p"].rlike(r"(?i)^(\.|%2e)$")
        kept = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(here, done).otherwise(F.concat(done, F.array(x["p"])))
        # A dot segment at the end leaves its slash.
        return F.when((up | here) & x["last"], F.concat(kept, F.array(F.lit("")))).otherwise(kept)

    def walked(parts: Column) -> Column:
        numbered = F.transform(parts, lambda p, i: fields(p=p, last=i == F.size(parts) - 1))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(numbered, F.lit(2), F.size(parts)), start, step), "/"))

    return let(F.split(path, "/"), walked)


def _path(tail: Column) -> Column:
    def escaped(text: Column) -> Column:
        letters = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(PATH_ENCODED), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
        return F.when(text.rlike(PATH_ENCODED), F.array_join(letters, "")).otherwise(text)

    return let(escaped(tail), lambda p: F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), _segments(p)).otherwise(p))


def _general(url: Column) -> Column:
    """scheme, user, host, port, path and query of any address; the host is empty where it is refused."""
    shape = r"^(\[[^\[\]]*\]|[^:\[\]]*)(?::([0-9]*))?$"

    def cut(text: Column) -> Column:
        kind = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        lenient = rf"(?i)^(?:{SPECIAL}):[/\\]*([^/\\?#]*)([^?#]*)"
        strict = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://([^/?#]*))?([^?#]*)"
        parts = {n: F.when(kind.isin(*PORTS), F.regexp_extract(text, lenient, i)).otherwise(F.regexp_extract(text, strict, i)) for i, n in ((1, "authority"), (2, "tail"))}
        return fields(scheme=kind, special=kind.isin(*PORTS), **parts, query=F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1))

    def whole(x: Column) -> Column:
        behind = F.regexp_replace(x["authority"], r"^.*@", "")
        number = F.regexp_extract(behind, shape, 2)
        fits = behind.rlike(shape) & (F.coalesce(F.nullif(number, F.lit("")).try_cast("bigint"), F.lit(0)) <= 65535) & (F.char_length(number) < 18)
        tail = _path(F.when(x["special"], F.replace(x["tail"], F.lit("\\"), F.lit("/"))).otherwise(x["tail"]))
        return fields(
            scheme=x["scheme"], user=F.regexp_extract(x["authority"], r"^(.*@)", 1), host=F.when(fits, _host(F.regexp_extract(behind, shape, 1))).otherwise(""),
            port=F.when(number.rlike("^0+$"), "0").otherwise(F.ltrim(number, F.lit("0"))), path=F.when(x["special"] & (tail == ""), "/").otherwise(tail), query=x["query"],
        )

    return let(let(_clean(url), cut), whole)


def _simple(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def host(url: Column) -> Column:
    """Lower-case host; empty where there is none or no browser would take it."""
    return F.coalesce(F.when(url.rlike(PLAIN), _simple(url, r"^https?://([^/?#]*)")).otherwise(_general(url)["host"]), F.lit(""))


def path(url: Column) -> Column:
    """The path, percent-encoded where needed; empty where there is no host."""
    simple = let(_simple(url, r"^https?://[^/?#]*([^?#]*)"), lambda p: F.when(p == "", "/").otherwise(p))
    general = let(_general(url), lambda x: F.when(x["host"] == "", "").otherwise(x["path"]))
    return F.coalesce(F.when(url.rlike(PLAIN), simple).otherwise(general), F.lit(""))


def registrable(name: Column) -> Column:
    labels = F.split(F.regexp_replace(F.lower(name), r"^www\.", ""), r"\.")
    n = F.size(labels)
    last = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(last.isin(*MULTI_PART), three).otherwise(last)


def depth(url: Column) -> Column:
    """Steps of the path; an empty step inside counts as one."""
    return let(F.regexp_replace(path(url), "^/|/$", ""), lambda steps: F.when(steps == "", 0).otherwise(F.size(F.split(steps, "/"))))


def is_html(url: Column) -> Column:
    return let(path(url), lambda p: (p != "") & ~p.rlike(ASSET))


def variants(url: Column) -> Column:
    apex = F.regexp_replace(host(url), r"^www\.", "")
    return F.array(*[F.concat(F.lit(p), apex, F.lit("/")) for p in ("http://", "https://", "http://www.", "https://www.")])


def form(raw: Column) -> Column:
    """Parameters as a form sends them, without tracking ones, by name."""

    def part(text: Column) -> Column:
        return _decoded(F.replace(text, F.lit("+"), F.lit(" ")))

    def cut(p: Column, i: Column) -> Column:
        behind = F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.char_length(p))).otherwise("")
        return fields(name=part(F.substring_index(p, "=", 1)), value=part(behind), i=i)

    def keyed(p: Column) -> Column:
        return fields(a=F.translate(F.lower(p["name"]), COLLATED, _PLACES), b=F.translate(p["name"], _LOWER + _UPPER, _UPPER + _LOWER), i=p["i"], name=p["name"], value=p["value"])

    kept = F.filter(F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), cut), lambda p: ~p["name"].rlike(TRACKING))
    # Equal names keep their order.
    shown = F.transform(F.array_sort(F.transform(kept, keyed)), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])))
    return F.when(raw == "", "").otherwise(F.array_join(shown, "&"))


def canonical(url: Column) -> Column:
    """Lower-case host, no fragment, tracking parameters, default port or trailing slash; parameters by name. Null for what is no http address."""
    empty = F.lit("")
    plain = fields(
        scheme=_simple(url, "^(https?)"), user=empty, host=_simple(url, r"^https?://([^/?#]*)"), port=empty, path=_simple(url, r"^https?://[^/?#]*([^?#]*)"), query=_simple(url, r"^[^?#]*\?([^#]*)"),
    )

    def whole(x: Column) -> Column:
        usual = (x["port"] == "") | ((x["scheme"] == "https") & (x["port"] == "443")) | ((x["scheme"] == "http") & (x["port"] == "80"))
        way = F.regexp_replace(x["path"], "/+$", "")
        asked = let(form(x["query"]), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        shown = F.concat(x["scheme"], F.lit("://"), x["user"], x["host"], F.when(usual, "").otherwise(F.concat(F.lit(":"), x["port"])), F.when(way == "", "/").otherwise(way), asked)
        return F.when(x["scheme"].isin("http", "https") & (x["host"] != ""), shown)

    return let(F.when(url.rlike(PLAIN), plain).otherwise(_general(url)), whole)


def normalise_input(text: Column, allow_local: bool = False) -> Column:
    """What a user typed as an absolute URL; null for what is no public host."""
    typed = trim(text)
    url = F.when(typed.rlike(r"(?i)^https?://"), typed).when(typed != "", F.concat(F.lit("https://"), typed))

    def judged(name: Column) -> Column:
        local = (name == "localhost") | name.endswith(".localhost") | name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (name == "[::1]")
        public = F.contains(name, F.lit(".")) & ~local
        return (name != "") & ((public | local) if allow_local else public)

    return F.when(let(host(url), judged), url)


def same_site(a: Column, b: Column) -> Column:
    """False where either has no host."""
    return let(fields(a=host(a), b=host(b)), lambda x: (x["a"] != "") & (x["b"] != "") & (registrable(x["a"]) == registrable(x["b"])))


def hashed_ip(ip: Column, salt: str) -> Column:
    """The first eight bytes of a salted SHA-256, as hex."""
    return F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, 16)


def report_name(host_name: Column, day: Column) -> Column:
    """File name of a report; without a day where that is null."""
    bare = F.regexp_replace(F.regexp_replace(host_name, r"^www\.", ""), "[^A-Za-z0-9.-]", "-")
    return F.concat(F.concat_ws("-", bare, F.date_format(day, "yyyy-MM-dd")), F.lit("-visibility-report.pdf"))


def email_domain(email: Column) -> Column:
    return trim(F.lower(F.element_at(F.split(email, "@"), -1)))
