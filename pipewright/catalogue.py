"""Driver queries for the language's functions and forms, family by family, each with SQL that must give the same rows.

An entry: name -> (table, program, fields of the program's rows, SQL).  The planner takes what it can to columns; the rest
runs in the dynamic tier, whose rows get the fields given.  Doubles are rounded to 4 digits on both sides.
"""

from __future__ import annotations

#: A list of the four-bit groups of the hexadecimal digits, for the SQL of base 32.
_NIBBLES = "['" + "','".join(f"{i:04b}" for i in range(16)) + "']"
_BITS = f"array_to_string(list_transform(string_split(lower(hex(encode(p_brand))), ''), lambda h: {_NIBBLES}[position(h in '0123456789abcdef')]), '')"
_FIVES = f"list_transform(range(0, (length({_BITS}) + 4) // 5), lambda i: rpad(substr({_BITS}, i::int * 5 + 1, 5), 5, '0'))"
_DIGIT = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(instr('01', b[1])-1)*16 + (instr('01', b[2])-1)*8 + (instr('01', b[3])-1)*4 + (instr('01', b[4])-1)*2 + (instr('01', b[5])-1) + 1]"
_BASE32 = f"array_to_string(list_transform({_FIVES}, lambda b: {_DIGIT}), '')"
_BASE32 = f"rpad({_BASE32}, ((length({_BASE32}) + 7) // 8 * 8)::int, '=')"


def _integral(body: str, low: str, high: str, n: int = 400) -> str:
    """Simpson's rule for a function of t, as SQL."""
    step = f"(({high}) - ({low})) / {n}.0"
    at = f"({low}) + k * {step}"
    weight = f"case when k = 0 or k = {n} then 1 when k % 2 = 1 then 4 else 2 end"
    return f"(list_sum(list_transform(range(0, {n + 1}), lambda k: ({weight}) * ({body.replace('{t}', '(' + at + ')')}))) * {step} / 3)"


def _bessel(n: int, x: str, second: bool = False) -> str:
    if not second:
        return f"({_integral(f'cos({n} * {{t}} - {x} * sin({{t}}))', '0', 'pi()')} / pi())"
    near = _integral(f"sin({x} * sin({{t}}) - {n} * {{t}})", "0", "pi()")
    far = _integral(f"(exp({n} * {{t}}) + {(-1) ** n} * exp(-{n} * {{t}})) * exp(-{x} * sinh({{t}}))", "0", "7", 1000)
    return f"({near} - {far}) / pi()"


def _doubles(names: str) -> str:
    return ", ".join(f"{n} double" for n in names.split())


def _rounded(pairs: dict[str, str]) -> str:
    return ", ".join(f"round(({e})::double, 4) as {n}" for n, e in pairs.items())


_X = "(value / 500.0)"
_UNARY = {
    "math_trigonometry": {
        "sin": f"sin{_X}", "cos": f"cos{_X}", "tan": f"tan{_X}", "asin": f"asin{_X}", "acos": f"acos{_X}", "atan": f"atan{_X}", "sinh": f"sinh{_X}", "cosh": f"cosh{_X}",
        "tanh": f"tanh{_X}", "asinh": f"asinh{_X}", "atanh": f"atanh{_X}",
    },
    "math_powers": {
        "exp": f"exp{_X}", "exp2": f"pow(2.0, {_X})", "exp10": f"pow(10.0, {_X})", "expm1": f"exp{_X} - 1", "log": f"ln{_X}", "log2": f"log2{_X}", "log10": f"log10{_X}",
        "log1p": f"ln(1 + {_X})", "sqrt": f"sqrt{_X}", "cbrt": f"cbrt{_X}",
    },
}

FAMILIES: dict[str, tuple[str, str, str, str]] = {
    name: ("events", ".[] | (.value / 500) as $x | {event_id, " + ", ".join(f"{f}: ($x | {f})" for f in sql) + "}", "event_id long, " + _doubles(" ".join(sql)), f"select event_id, {_rounded(sql)} from events")
    for name, sql in _UNARY.items()
}

FAMILIES |= {
    "math_hyperbolic_inverse": ("events", ".[] | {event_id, acosh: (.value + 1 | acosh)}", "event_id long, acosh double", "select event_id, round(acosh(value + 1), 4) as acosh from events"),
    "math_rounding": (
        "events",
        ".[] | (.value / 10 - 20) as $x | {event_id, floor: ($x | floor), ceil: ($x | ceil), trunc: ($x | trunc), fabs: ($x | fabs), abs: ($x | abs), round: ($x * 1.001 | round), rint: ($x * 1.001 | rint), nearbyint: ($x * 1.001 | nearbyint)}",
        "event_id long, " + _doubles("floor ceil trunc fabs abs round rint nearbyint"),
        "with t as (select event_id, value / 10 - 20 as x from events) select event_id, floor(x)::double as floor, ceil(x)::double as ceil, trunc(x)::double as trunc, round(abs(x), 4) as fabs, round(abs(x), 4) as abs, round(x * 1.001)::double as round, round_even(x * 1.001, 0)::double as rint, round_even(x * 1.001, 0)::double as nearbyint from t",
    ),
    "math_floating_parts": (
        "events",
        ".[] | (.value + 0.123456789) as $x | {event_id, significand: ($x | significand), logb: ($x | logb), ilogb: ($x | ilogb), mantissa: ($x | frexp | .[0]), exponent: ($x | frexp | .[1]), fraction: ($x | modf | .[0]), whole: ($x | modf | .[1])}",
        "event_id long, " + _doubles("significand logb ilogb mantissa exponent fraction whole"),
        "with t as (select event_id, value + 0.123456789::double as value, floor(log2(value + 0.123456789::double)) as e from events) select event_id, round(value / pow(2, e), 4) as significand, e::double as logb, e::double as ilogb, round(value / pow(2, e + 1), 4) as mantissa, (e + 1)::double as exponent, round(value - trunc(value), 4) as fraction, trunc(value)::double as whole from t",
    ),
    "math_two_numbers": (
        "events",
        ".[] | .value as $x | (.user_id + 1) as $y | {event_id, atan2: atan2($x; $y), pow: pow($x / 500; 3), hypot: hypot($x; $y), fmod: fmod($x; $y), copysign: copysign($x; -1), nextafter: (nextafter($x; 1000) - $x > 0), fdim: fdim($x; $y), fmax: fmax($x; $y), fmin: fmin($x; $y), ldexp: ldexp($x; 3), scalb: scalb($x; 2), scalbln: scalbln($x; 1)}",
        "event_id long, atan2 double, pow double, hypot double, fmod double, copysign double, nextafter boolean, " + _doubles("fdim fmax fmin ldexp scalb scalbln"),
        "with t as (select event_id, value as x, user_id + 1.0::double as y from events) select event_id, round(atan2(x, y), 4) as atan2, round(pow(x / 500, 3), 4) as pow, round(sqrt(x * x + y * y), 4) as hypot, round(fmod(x, y), 4) as fmod, round(-x, 4) as copysign, nextafter(x, 1000) > x as nextafter, round(greatest(x - y, 0), 4) as fdim, round(greatest(x, y), 4) as fmax, round(least(x, y), 4) as fmin, round(x * 8, 4) as ldexp, round(x * 4, 4) as scalb, round(x * 2, 4) as scalbln from t",
    ),
    "math_remainders": (
        "events",
        ".[] | .value as $x | (.user_id + 1) as $y | {event_id, remainder: remainder($x; $y), drem: drem($x; $y), fma: fma($x; $y; 1)}",
        "event_id long, remainder double, drem double, fma double",
        "with t as (select event_id, value as x, user_id + 1.0::double as y from events) select event_id, round(x - y * round_even(x / y, 0), 4) as remainder, round(x - y * round_even(x / y, 0), 4) as drem, round(x * y + 1, 4) as fma from t",
    ),
    "math_gamma_error": (
        "supplier",
        ".[] | (.s_suppkey % 12 / 4 + 0.5) as $x | {s_suppkey, tgamma: ($x | tgamma), gamma: ($x | gamma), lgamma: ($x | lgamma), lgamma_r: ($x | lgamma_r | .[0]), sign: ($x | lgamma_r | .[1]), erf: ($x | erf), erfc: ($x | erfc)}",
        "s_suppkey long, " + _doubles("tgamma gamma lgamma lgamma_r sign erf erfc"),
        "with t as (select s_suppkey, s_suppkey % 12 / 4.0 + 0.5::double as x from supplier), e as (select *, " + _integral("exp(-{t} * {t})", "0", "x") + " * 2 / sqrt(pi()) as erf from t) select s_suppkey, round(gamma(x), 4) as tgamma, round(lgamma(x), 4) as gamma, round(lgamma(x), 4) as lgamma, round(lgamma(x), 4) as lgamma_r, 1.0::double as sign, round(erf, 4) as erf, round(1 - erf, 4) as erfc from e",
    ),
    "math_bessel": (
        "supplier",
        ".[] | (.s_suppkey % 9 + 1) as $x | {s_suppkey, j0: ($x | j0), j1: ($x | j1), y0: ($x | y0), y1: ($x | y1), jn: jn(2; $x), yn: yn(2; $x)}",
        "s_suppkey long, " + _doubles("j0 j1 y0 y1 jn yn"),
        "with t as (select s_suppkey, s_suppkey % 9 + 1.0::double as x from supplier) select s_suppkey, " + _rounded({"j0": _bessel(0, "x"), "j1": _bessel(1, "x"), "y0": _bessel(0, "x", True), "y1": _bessel(1, "x", True), "jn": _bessel(2, "x"), "yn": _bessel(2, "x", True)}) + " from t",
    ),
    "math_kinds": (
        "nation",
        ".[] | (if .n_nationkey % 3 == 0 then nan elif .n_nationkey % 3 == 1 then infinite else .n_nationkey end) as $x | {n_nationkey, nan: ($x | isnan), inf: ($x | isinfinite), normal: ($x | isnormal), finite: ($x | isfinite), finites: ([$x | finites] | length), normals: ([$x, 0 | normals] | length)}",
        "n_nationkey long, nan boolean, inf boolean, normal boolean, finite boolean, finites long, normals long",
        "select n_nationkey, n_nationkey % 3 = 0 as nan, n_nationkey % 3 = 1 as inf, n_nationkey % 3 = 2 as normal, n_nationkey % 3 <> 1 as finite, (n_nationkey % 3 <> 1)::bigint as finites, (n_nationkey % 3 = 2)::bigint as normals from nation",
    ),
    "compare_numbers": (
        "nation",
        ".[] | .n_nationkey as $a | (.n_regionkey * 5) as $b | {n_nationkey, eq: ($a == $b), ne: ($a != $b), lt: ($a < $b), le: ($a <= $b), gt: ($a > $b), ge: ($a >= $b), both: ($a > 3 and $b > 3), either: ($a > 20 or $b > 15), no: ($a > 3 | not)}",
        "n_nationkey long, eq boolean, ne boolean, lt boolean, le boolean, gt boolean, ge boolean, both boolean, either boolean, no boolean",
        "with t as (select n_nationkey, n_nationkey as a, n_regionkey * 5 as b from nation) select n_nationkey, a = b as eq, a <> b as ne, a < b as lt, a <= b as le, a > b as gt, a >= b as ge, a > 3 and b > 3 as both, a > 20 or b > 15 as either, not a > 3 as no from t",
    ),
    "compare_kinds": (
        "nation",
        ".[] | {n_nationkey, sorted: ([.n_name, {a: 1}, [2], .n_nationkey, true, null, false] | sort | map(type) | join(\" \")), least: ([.n_nationkey, null] | min == null), last: ([[], .n_name] | max | type), mixed: (.n_name > .n_nationkey), arrays: ([.n_regionkey, 1] < [.n_regionkey, 2]), objects: ({a: 2} < {b: 1})}",
        "n_nationkey long, sorted string, least boolean, last string, mixed boolean, arrays boolean, objects boolean",
        "select n_nationkey, 'null boolean boolean number string array object' as sorted, true as least, 'array' as last, true as mixed, true as arrays, true as objects from nation",
    ),
    "arithmetic_kinds": (
        "nation",
        '.[] | {n_nationkey, text: (.n_name + "!"), none: (null + .n_regionkey), more: ([.n_regionkey] + [9] | tojson), less: ([1, 2, 3, 2] - [2] | tojson), merged: ({a: 1, b: {c: 2}} + {b: {d: .n_regionkey}} | tojson), deep: ({a: 1, b: {c: 2}} * {b: {d: .n_regionkey}} | tojson), twice: ("ab" * 2), parts: (.n_name / "A" | length), rest: (.n_nationkey % 7 - 10 | . % 4), minus: (-(.n_regionkey))}',
        "n_nationkey long, text string, none long, more string, less string, merged string, deep string, twice string, parts long, rest long, minus long",
        """select n_nationkey, n_name || '!' as text, n_regionkey::bigint as none, '[' || n_regionkey || ',9]' as more, '[1,3]' as less, '{"a":1,"b":{"d":' || n_regionkey || '}}' as merged, '{"a":1,"b":{"c":2,"d":' || n_regionkey || '}}' as deep, 'abab' as twice, len(string_split(n_name, 'A'))::bigint as parts, ((n_nationkey % 7 - 10) % 4)::bigint as rest, (-n_regionkey)::bigint as minus from nation""",
    ),
    "conversions": (
        "part",
        '.[] | {p_partkey, kind: (.p_size | type), text: (.p_size | tostring), same: (.p_brand | tostring), json: (.p_brand | tojson), back: (.p_size | tojson | fromjson), number: (.p_size | tostring | tonumber), flag: ("true" | toboolean), bytes: ("é" + .p_brand | utf8bytelength), codes: (.p_brand | explode | tojson), again: (.p_brand | explode | implode), letter: (65 + .p_size % 26 | ascii), long: (.p_brand | length), size: (-(.p_size) | length), parsed: (.p_partkey | tostring | "[" + . + ",{}]" | fromjson | length), shown: (.p_brand | @text), shown_json: ([.p_brand] | @json)}',
        "p_partkey long, kind string, text string, same string, json string, back long, number long, flag boolean, bytes long, codes string, again string, letter string, long long, size long, parsed long, shown string, shown_json string",
        """select p_partkey, 'number' as kind, p_size::varchar as text, p_brand as same, '"' || p_brand || '"' as json, p_size::bigint as back, p_size::bigint as number, true as flag, (octet_length(encode(p_brand)) + 2)::bigint as bytes, '[' || array_to_string(list_transform(string_split(p_brand, ''), lambda c: ord(c)), ',') || ']' as codes, p_brand as again, chr((65 + p_size % 26)::int) as letter, length(p_brand) as long, p_size::bigint as size, 2::bigint as parsed, p_brand as shown, '["' || p_brand || '"]' as shown_json from part""",
    ),
    "string_edges": (
        "part",
        '.[] | {p_partkey, starts: (.p_name | startswith("s")), ends: (.p_name | endswith("t")), trim: ("  " + .p_name + "\\t" | trim), left: ("  " + .p_name + " " | ltrim), right: ("  " + .p_name + " " | rtrim), less: (.p_name | ltrimstr("red ")), cut: (.p_name | rtrimstr("ring")), both: ("xx" + .p_name + "xx" | trimstr("xx")), up: (.p_name | ascii_upcase), down: (.p_type | ascii_downcase), slice: (.p_name | .[1:3]), tail: (.p_name | .[-3:]), words: (.p_name | split(" ") | tojson), regular: (.p_name | split("[aeiou]"; null) | length), joined: ([.p_name, .p_size, null, true] | join("/"))}',
        "p_partkey long, starts boolean, ends boolean, trim string, left string, right string, less string, cut string, both string, up string, down string, slice string, tail string, words string, regular long, joined string",
        """select p_partkey, starts_with(p_name, 's') as starts, ends_with(p_name, 't') as ends, p_name as trim, p_name || ' ' as left, '  ' || p_name as right, case when starts_with(p_name, 'red ') then substr(p_name, 5) else p_name end as less, case when ends_with(p_name, 'ring') then left(p_name, length(p_name) - 4) else p_name end as cut, p_name as both, upper(p_name) as up, lower(p_type) as down, substr(p_name, 2, 2) as slice, right(p_name, 3) as tail, '["' || replace(p_name, ' ', '","') || '"]' as words, len(string_split_regex(p_name, '[aeiou]'))::bigint as regular, p_name || '/' || p_size || '//true' as joined from part""",
    ),
    "string_search": (
        "part",
        '.[] | {p_partkey, all: (.p_name | indices("e") | tojson), first: (.p_name | index("e")), last: (.p_name | rindex("e")), has: (.p_name | contains("ri")), within: ("ed" as $e | .p_name as $n | $e | inside($n)), lists: ([.p_name, "x"] | contains(["x"])), missing: (.p_name | index("#"))}',
        "p_partkey long, all string, first long, last long, has boolean, within boolean, lists boolean, missing long",
        """with t as (select p_partkey, p_name, list_filter(range(0, length(p_name)), lambda i: p_name[i::int + 1] = 'e') as spots from part) select p_partkey, '[' || array_to_string(spots, ',') || ']' as "all", spots[1] as "first", spots[-1] as "last", contains(p_name, 'ri') as has, contains(p_name, 'ed') as within, true as lists, null::bigint as missing from t""",
    ),
    "regular_tests": (
        "part",
        '.[] | {p_partkey, plain: (.p_name | test("r.d")), caseless: (.p_name | test("R.D"; "i")), listed: (.p_name | test(["R.D", "ix"])), offset: ([.p_name | match("[aeiou]") | .offset][0]), count: ([.p_name | match("[aeiou]"; "g")] | length), found: ([.p_name | match("[aeiou]"; "g").string] | join("")), capture: (.p_brand | capture("(?<word>[A-Z]+)#(?<number>[0-9]+)"; "i") | .number), whole: (.p_brand | capture("(?<w>B.*)") | .w), scan: ([.p_name | scan("[a-z]+")] | join("+")), groups: ([.p_brand | scan("([a-z])([0-9#])")] | tojson), flagged: ([.p_name | scan("[A-Z]"; "i")] | length)}',
        "p_partkey long, plain boolean, caseless boolean, listed boolean, offset long, count long, found string, capture string, whole string, scan string, groups string, flagged long",
        """select p_partkey, regexp_matches(p_name, 'r.d') as plain, regexp_matches(p_name, 'R.D', 'i') as caseless, regexp_matches(p_name, 'R.D', 'i') as listed, nullif(length(regexp_extract(p_name, '^([^aeiou]*)[aeiou]', 1)), -1) as offset, len(regexp_extract_all(p_name, '[aeiou]'))::bigint as count, array_to_string(regexp_extract_all(p_name, '[aeiou]'), '') as found, regexp_extract(p_brand, '#([0-9]+)', 1) as capture, p_brand as whole, array_to_string(regexp_extract_all(p_name, '[a-z]+'), '+') as scan, '[["d","#"]]' as groups, len(regexp_extract_all(p_name, '[A-Za-z]'))::bigint as flagged from part""",
    ),
    "regular_changes": (
        "part",
        '.[] | {p_partkey, sub: (.p_name | sub("[aeiou]"; "_")), sub3: (.p_name | sub("[AEIOU]"; "_"; "gi")), gsub: (.p_name | gsub("(?<v>[aeiou])"; "<\\(.v)>")), gsub3: (.p_name | gsub("[AEIOU]"; ""; "i")), splits: ([.p_name | splits(" +")] | tojson), splits2: ([.p_name | splits("E"; "i")] | length)}',
        "p_partkey long, sub string, sub3 string, gsub string, gsub3 string, splits string, splits2 long",
        """select p_partkey, regexp_replace(p_name, '[aeiou]', '_') as sub, regexp_replace(p_name, '[aeiou]', '_', 'g') as sub3, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') as gsub, regexp_replace(p_name, '[aeiou]', '', 'g') as gsub3, '["' || replace(p_name, ' ', '","') || '"]' as splits, len(string_split(p_name, 'e'))::bigint as splits2 from part""",
    ),
    "formats_escapes": (
        "part",
        '.[] | ("<" + .p_brand + "&\\"\'>") as $t | {p_partkey, html: ($t | @html), htmld: ($t | @html | @htmld), entity: ("&#65;&#x42;&nope;" | @htmld), uri: ($t | @uri), urid: ($t | @uri | @urid), sh: ([.p_brand, .p_size] | @sh), csv: ([.p_brand, .p_size, null, true, "a\\"b"] | @csv), tsv: ([.p_brand, .p_size, "a\\tb"] | @tsv), hex: (.p_brand | @hex), hexd: (.p_brand | @hex | @hexd), text: ([.p_size] | @text), json: (.p_brand | @json), filled: @base64 "x\\(.p_brand)"}',
        "p_partkey long, html string, htmld string, entity string, uri string, urid string, sh string, csv string, tsv string, hex string, hexd string, text string, json string, filled string",
        """with t as (select *, '<' || p_brand || '&"''>' as t from part) select p_partkey, '&lt;' || p_brand || '&amp;&quot;&apos;&gt;' as html, t as htmld, 'AB&nope;' as entity, url_encode(t) as uri, t as urid, '''' || p_brand || ''' ' || p_size as sh, '"' || p_brand || '",' || p_size || ',,true,"a""b"' as csv, p_brand || chr(9) || p_size || chr(9) || 'a\\tb' as tsv, lower(hex(encode(p_brand))) as hex, p_brand as hexd, '[' || p_size || ']' as text, '"' || p_brand || '"' as json, 'x' || to_base64(encode(p_brand)) as filled from t""",
    ),
    "formats_base": (
        "part",
        ".[] | {p_partkey, b64: (.p_brand | @base64), b64d: (.p_brand | @base64 | @base64d), b32: (.p_brand | @base32), b32d: (.p_brand | @base32 | @base32d)}",
        "p_partkey long, b64 string, b64d string, b32 string, b32d string",
        f"select p_partkey, to_base64(encode(p_brand)) as b64, p_brand as b64d, {_BASE32} as b32, p_brand as b32d from part",
    ),
    "digests_all": (
        "part",
        ".[] | {p_partkey, one: (.p_name | sha1), two: (.p_name | sha256), long: (.p_name | sha512 | length)}",
        "p_partkey long, one string, two string, long long",
        "select p_partkey, sha1(p_name) as one, sha256(p_name) as two, 128::bigint as long from part",
    ),
    "dates_parts": (
        "orders",
        '.[] | (.o_orderdate | .[:19] + "Z") as $d | ($d | fromdateiso8601) as $t | {o_orderkey, t: $t, year: ($t | gmtime | .[0]), month: ($t | gmtime | .[1]), day: ($t | gmtime | .[2]), weekday: ($t | gmtime | .[6]), yearday: ($t | gmtime | .[7]), back: ($t | gmtime | mktime), local: ($t | localtime | .[3] >= 0), short: (try ([2000, 1] | mktime) catch null)}',
        "o_orderkey long, t long, year long, month long, day long, weekday long, yearday long, back long, local boolean, short long",
        "select o_orderkey, epoch(o_orderdate)::bigint as t, year(o_orderdate) as year, month(o_orderdate) - 1 as month, day(o_orderdate) as day, dayofweek(o_orderdate)::bigint as weekday, dayofyear(o_orderdate) - 1 as yearday, epoch(o_orderdate)::bigint as back, true as local, null::bigint as short from orders",
    ),
    "dates_texts": (
        "orders",
        '.[] | (.o_orderdate | .[:19] + "Z" | fromdate) as $t | {o_orderkey, iso: ($t | todate), iso2: ($t | todateiso8601), day: ($t | strftime("%Y/%m/%d %H:%M:%S")), name: ($t | gmtime | strftime("%A %d %B")), local: ($t | strflocaltime("%Y") | length), parsed: ($t | strftime("%d.%m.%Y") | strptime("%d.%m.%Y") | mktime)}',
        "o_orderkey long, iso string, iso2 string, day string, name string, local long, parsed long",
        "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso2, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') as day, strftime(o_orderdate, '%A %d %B') as name, 4::bigint as local, epoch(date_trunc('day', o_orderdate))::bigint as parsed from orders",
    ),
    "chance": (
        "nation",
        ".[] | {n_nationkey, random: (random | . >= 0 and . < 1), one: (randint(5) | . >= 0 and . < 5), two: (randint(3; 6) | . >= 3 and . < 6), choice: (.n_nationkey as $k | [$k] | choice), four: (uuidv4 | .[14:15]), seven: (uuidv7 | .[14:15]), now: (now > 1700000000)}",
        "n_nationkey long, random boolean, one boolean, two boolean, choice long, four string, seven string, now boolean",
        "select n_nationkey, true as random, true as one, true as two, n_nationkey::bigint as choice, '4' as four, '7' as seven, true as now from nation",
    ),
    "arrays_order": (
        "embeddings",
        ".[] | [.embedding[:8][] | . * 10 | floor] as $a | {vec_id, sort: ($a | sort), unique: ($a | unique), min: ($a | min), max: ($a | max), reverse: ($a | reverse), sort_by: ($a | sort_by(-.)), least: ($a | min_by(. * .) | . * .), most: ($a | max_by(. * .) | . * .), found: ($a | sort | bsearch(($a | sort)[0])), missing: ($a | sort | bsearch(1000))}",
        "vec_id long, sort array<long>, unique array<long>, min long, max long, reverse array<long>, sort_by array<long>, least long, most long, found long, missing long",
        "with t as (select vec_id, list_transform(embedding[1:8], lambda x: floor(x::double * 10)::bigint) as a from embeddings) select vec_id, list_sort(a) as sort, list_sort(list_distinct(a)) as unique, list_min(a) as min, list_max(a) as max, list_reverse(a) as reverse, list_reverse_sort(a) as sort_by, list_min(list_transform(a, lambda x: x * x)) as least, list_max(list_transform(a, lambda x: x * x)) as most, case when len(list_filter(a, lambda x: x = list_min(a))) > 0 then 0 end::bigint as found, -9::bigint as missing from t",
    ),
    "arrays_groups": (
        "embeddings",
        ".[] | [.embedding[:12][] | . * 4 | floor] as $a | {vec_id, groups: ($a | group_by(.) | map(length)), firsts: ($a | unique_by(. % 2 == 0) | length), sum: ($a | add), sum1: add($a[] | . * 2), any: ($a | any(. > 4)), all: ($a | all(. > -9)), any0: ($a | map(. > 0) | any), all0: ($a | map(. > 0) | all), any2: any($a[]; . == 0), all2: all($a[]; . != 3), odd: ([$a[] | select(. % 2 != 0)] | length)}",
        "vec_id long, groups array<long>, firsts long, sum long, sum1 long, any boolean, all boolean, any0 boolean, all0 boolean, any2 boolean, all2 boolean, odd long",
        "with t as (select vec_id, list_transform(embedding[1:12], lambda x: floor(x::double * 4)::bigint) as a from embeddings) select vec_id, list_transform(list_sort(list_distinct(a)), lambda x: len(list_filter(a, lambda y: y = x))::bigint) as groups, len(list_distinct(list_transform(a, lambda x: x % 2 = 0)))::bigint as firsts, list_sum(a)::bigint as sum, 2 * list_sum(a)::bigint as sum1, list_max(a) > 4 as any, list_min(a) > -9 as all, list_max(a) > 0 as any0, list_min(a) > 0 as all0, list_contains(a, 0) as any2, not list_contains(a, 3) as all2, len(list_filter(a, lambda x: x % 2 <> 0))::bigint as odd from t",
    ),
    "arrays_shapes": (
        "nation",
        ".[] | .n_nationkey as $n | .n_regionkey as $r | {n_nationkey, flat: ([$n, [$r, [1]]] | flatten | length), flat1: ([$n, [$r, [1]]] | flatten(1) | length), turned: ([[$n, 1], [$r]] | transpose | tojson), pairs: ([[$n, $r], [1, 2]] | [combinations] | length), cubes: ([$n, $r] | [combinations(3)] | length), first: ([$n, $r] | first), last: ([$n, $r] | last), nth: ([$n, $r] | nth(1)), at: [$n, $r][-1], none: ([] | first), sub: ([1, 2, 1, 2] | indices([1, 2]) | tojson), spots: ([$r, 0, $r] | indices($r) | length), where: ([5, $n] | index($n)), keys: ([$n, $r] | keys | tojson), has: ([$n] | has(0)), map: ([1, 2] | map(. + $n) | tojson), empty: ([1, 2] | map(empty) | length), slice: ([range(10)] | .[2:$r + 3] | length), contains: ([$n, [$r]] | contains([[$r]]))}",
        "n_nationkey long, flat long, flat1 long, turned string, pairs long, cubes long, first long, last long, nth long, at long, none long, sub string, spots long, where long, keys string, has boolean, map string, empty long, slice long, contains boolean",
        """select n_nationkey, 3::bigint as flat, 3::bigint as flat1, '[[' || n_nationkey || ',' || n_regionkey || '],[1,null]]' as turned, 4::bigint as pairs, 8::bigint as cubes, n_nationkey::bigint as first, n_regionkey::bigint as last, n_regionkey::bigint as nth, n_regionkey::bigint as at, null::bigint as none, '[0,2]' as sub, case when n_regionkey = 0 then 3 else 2 end::bigint as spots, case when n_nationkey = 5 then 0 else 1 end::bigint as where, '[0,1]' as keys, true as has, '[' || (n_nationkey + 1) || ',' || (n_nationkey + 2) || ']' as map, 0::bigint as empty, (n_regionkey + 1)::bigint as slice, true as contains from nation""",
    ),
    "objects_all": (
        "nation",
        '.[] | {b: .n_nationkey, a: .n_name} as $o | {n_nationkey, keys: ($o | keys | join(",")), given: ($o | keys_unsorted | join(",")), size: ($o | length), has: ($o | has("a")), in: ("b" | in($o)), entries: ($o | to_entries | map(.key) | join(",")), back: ($o | to_entries | from_entries | .b), named: ([{name: "x", value: $o.b}] | from_entries | .x), with: ($o | with_entries(.key |= "k" + .) | keys | join(",")), values: ({x: 1, y: $o.b} | map_values(. + 1) | .y), fewer: ({x: 1, y: 2} | map_values(select(. > 1)) | tojson), del: ($o | del(.a) | tojson), pick: ($o | pick(.b) | tojson), contains: ($o | contains({b: $o.b})), computed: {($o.a): 1}[$o.a], any: ({x: false, y: true} | any), text: ($o | tostring | length)}',
        "n_nationkey long, keys string, given string, size long, has boolean, in boolean, entries string, back long, named long, with string, values long, fewer string, del string, pick string, contains boolean, computed long, any boolean, text long",
        """select n_nationkey, 'a,b' as keys, 'b,a' as given, 2::bigint as size, true as has, true as in, 'b,a' as entries, n_nationkey::bigint as back, n_nationkey::bigint as named, 'ka,kb' as with, (n_nationkey + 1)::bigint as values, '{"y":2}' as fewer, '{"b":' || n_nationkey || '}' as del, '{"b":' || n_nationkey || '}' as pick, true as contains, 1::bigint as computed, true as any, (length(n_nationkey::varchar) + length(n_name) + 13)::bigint as text from nation""",
    ),
    "selectors": (
        "nation",
        ".[] | [.n_nationkey, .n_name, null, true, [.n_regionkey], {}, 0] as $v | {n_nationkey, arrays: ([$v[] | arrays] | length), objects: ([$v[] | objects] | length), iterables: ([$v[] | iterables] | length), booleans: ([$v[] | booleans] | length), numbers: ([$v[] | numbers] | add), strings: ([$v[] | strings][0]), nulls: ([$v[] | nulls] | length), values: ([$v[] | values] | length), scalars: ([$v[] | scalars] | length), types: ($v | map(type) | join(\" \"))}",
        "n_nationkey long, arrays long, objects long, iterables long, booleans long, numbers long, strings string, nulls long, values long, scalars long, types string",
        "select n_nationkey, 1::bigint as arrays, 1::bigint as objects, 2::bigint as iterables, 1::bigint as booleans, n_nationkey::bigint as numbers, n_name as strings, 1::bigint as nulls, 6::bigint as values, 5::bigint as scalars, 'number string null boolean array object number' as types from nation",
    ),
    "paths_read": (
        "nation",
        '.[] | {a: [.n_nationkey, {b: .n_name}]} as $o | {n_nationkey, path: ([$o | path(.a[1].b)] | tojson), paths: ([$o | paths] | tojson), numbers: ([$o | paths(type == "number")] | tojson), leaves: ([$o | leaf_paths] | length), get: ($o | getpath(["a", 1, "b"])), none: ($o | getpath(["x", "y"])), down: ([$o | ..] | length), recurse: ([$o | recurse] | length), grown: ([$o | recurse(.a?; . != null)] | length), doubled: ([1 | recurse(if . < 20 then . * 2 else empty end)] | tojson), steps: ([$o | path(..)] | length)}',
        "n_nationkey long, path string, paths string, numbers string, leaves long, get string, none string, down long, recurse long, grown long, doubled string, steps long",
        """select n_nationkey, '[["a",1,"b"]]' as path, '[["a"],["a",0],["a",1],["a",1,"b"]]' as paths, '[["a",0]]' as numbers, 2::bigint as leaves, n_name as get, null::varchar as none, 5::bigint as down, 5::bigint as recurse, 2::bigint as grown, '[1,2,4,8,16,32]' as doubled, 5::bigint as steps from nation""",
    ),
    "paths_write": (
        "nation",
        '.[] | {a: [.n_nationkey, {b: .n_name}]} as $o | .n_regionkey as $r | {n_nationkey, set: ($o | setpath(["a", 1, "c"]; $r) | tojson), new: (null | setpath(["x", 1]; $r) | tojson), gone: ($o | delpaths([["a", 0], ["a", 1, "b"]]) | tojson), del: ($o | del(.a[0], .a[1].b) | tojson), pick: ($o | pick(.a[1].b) | tojson), walk: ($o | walk(if type == "number" then . + 1 else . end) | .a[0]), entries: ([$o | tostream] | length), events: ([$o | tostream][0] | tojson), back: ([$o | fromstream(tostream)][0] == $o), cut: ([1 | truncate_stream([[0], 1], [[1, 0], 2], [[1, 0]], [[1]])] | tojson)}',
        "n_nationkey long, set string, new string, gone string, del string, pick string, walk long, entries long, events string, back boolean, cut string",
        """select n_nationkey, '{"a":[' || n_nationkey || ',{"b":"' || n_name || '","c":' || n_regionkey || '}]}' as set, '{"x":[null,' || n_regionkey || ']}' as new, '{"a":[{}]}' as gone, '{"a":[{}]}' as del, '{"a":[null,{"b":"' || n_name || '"}]}' as pick, (n_nationkey + 1)::bigint as walk, 5::bigint as entries, '[["a",0],' || n_nationkey || ']' as events, true as back, '[[[0],2],[[0]]]' as cut from nation""",
    ),
    "assignments": (
        "nation",
        '.[] | {n_nationkey, x: (. | .n_regionkey = 5 | .n_regionkey), up: (.n_regionkey |= . + 1 | .n_regionkey), add: (.n_regionkey += 2 | .n_regionkey), sub: (.n_regionkey -= 2 | .n_regionkey), mul: (.n_regionkey *= 3 | .n_regionkey), div: (.n_regionkey /= 2 | .n_regionkey), mod: (.n_regionkey %= 2 | .n_regionkey), alt: (.none //= .n_name | .none), false: ({f: false} | .f //= 3 | .f), many: ([1, 2, 3] | .[] += 1 | tojson), first: ([1, 2, 3] | (.[] | select(. > 1)) |= empty | tojson), slice: ([1, 2, 3, 4] | .[1:3] = [9] | tojson), nested: ({} | .a.b[1] = 1 | tojson), each: ({a: 1, b: 2} | .[] *= 10 | tojson)}',
        "n_nationkey long, x long, up long, add long, sub long, mul long, div double, mod long, alt string, false long, many string, first string, slice string, nested string, each string",
        """select n_nationkey, 5::bigint as x, (n_regionkey + 1)::bigint as up, (n_regionkey + 2)::bigint as add, (n_regionkey - 2)::bigint as sub, (n_regionkey * 3)::bigint as mul, n_regionkey / 2.0::double as div, (n_regionkey % 2)::bigint as mod, n_name as alt, 3::bigint as false, '[2,3,4]' as many, '[1]' as first, '[1,9,4]' as slice, '{"a":{"b":[null,1]}}' as nested, '{"a":10,"b":20}' as each from nation""",
    ),
    "generators": (
        "nation",
        ".[] | .n_regionkey as $r | {n_nationkey, one: [range($r)], two: [range(1; $r + 1)], three: [range(10; 0; -3)], while: [$r + 1 | while(. < 20; . * 2)], until: ($r + 1 | until(. > 50; . * 3)), repeat: [limit(3; repeat($r))], limit: [limit(2; range(9))], skip: [skip(7; range(9))], first: first(range($r; 99)), last: last(range($r + 1)), nth: nth(2; range(9)), empty: ([empty] | length), isempty: isempty(range($r)), some: ([$r, null | select(. != null)] | length)}",
        "n_nationkey long, one array<long>, two array<long>, three array<long>, while array<long>, until long, repeat array<long>, limit array<long>, skip array<long>, first long, last long, nth long, empty long, isempty boolean, some long",
        "with t as (select n_nationkey, n_regionkey::bigint as r from nation) select n_nationkey, range(r) as one, range(1, r + 1) as two, [10, 7, 4, 1]::bigint[] as three, list_filter(list_transform(range(0, 5), lambda i: ((r + 1) * (1 << i))::bigint), lambda x: x < 20) as while, list_filter(list_transform(range(0, 6), lambda i: ((r + 1) * pow(3, i))::bigint), lambda x: x > 50)[1] as until, [r, r, r] as repeat, [0, 1]::bigint[] as limit, [7, 8]::bigint[] as skip, r as first, r as last, 2::bigint as nth, 0::bigint as empty, r = 0 as isempty, 1::bigint as some from t",
    ),
    "control": (
        "nation",
        """.[] | .n_regionkey as $r | # a comment
        {n_nationkey, if: ($r | if . == 0 then "zero" end | tostring), elif: (if $r == 0 then "a" elif $r < 3 then "b" else "c" end), truth: (if 0 then "yes" else "no" end), alt: (false // null // $r), none: ([(null, false) // "x"][0]), try: (try error("bad") catch ("caught " + .)), object: (try error({code: $r}) catch .code), optional: ([.n_name.x?] | length), many: ([.[] | tonumber?] | length), label: [label $out | range(9) | if . > $r then break $out else . end], both: ([$r, 1] | .[0] as $x | .[1] as $y | $x + $y), list: ([$r, [2]] as [$a, [$b]] | $a + $b), map: ({a: $r, b: [3]} as {a: $x, b: [$y]} | $x + $y), either: ([[$r]] | .[] as [$a] ?// $a | $a), reduce: reduce range(5) as $i (0; . + $i * $r), foreach: [foreach range(4) as $i (0; . + $i; [$i, .][1] * 2)], and: [(true, false) and (true, false)], text: "\\($r)-\\(1 + 1)", loc: ($__loc__ | type), comma: [$r, ($r, 1) + 1]}""",
        "n_nationkey long, if string, elif string, truth string, alt long, none string, try string, object long, optional long, many long, label array<long>, both long, list long, map long, either long, reduce long, foreach array<long>, and array<boolean>, text string, loc string, comma array<long>",
        """with t as (select n_nationkey, n_regionkey::bigint as r from nation) select n_nationkey, case when r = 0 then 'zero' else r::varchar end as "if", case when r = 0 then 'a' when r < 3 then 'b' else 'c' end as elif, 'yes' as truth, r as alt, 'x' as none, 'caught bad' as try, r as object, 0::bigint as optional, 2::bigint as many, range(0, r + 1) as label, r + 1 as both, r + 2 as list, r + 3 as map, r as either, 10 * r as reduce, [0, 2, 6, 12]::bigint[] as foreach, [true, false, false] as "and", r || '-2' as text, 'object' as loc, [r, r + 1, 2]::bigint[] as comma from t""",
    ),
    "functions": (
        "nation",
        ".[] | def twice(f): f | f; def plus($n): . + $n; def pair(a; $b): [a, $b]; def fact: if . <= 1 then 1 else . * (. - 1 | fact) end; def down: if . <= 0 then . else . - 1 | down end; def outer: def inner: . * 2; inner + 1; .n_regionkey as $r | {n_nationkey, twice: ($r | twice(. + 1)), plus: ($r | plus(10)), pair: ($r | pair(. + 1; . + 2)), fact: ($r + 3 | fact), deep: (3000 | down), nested: ($r | outer), many: [$r | plus(1, 2)]}",
        "n_nationkey long, twice long, plus long, pair array<long>, fact long, deep long, nested long, many array<long>",
        "with t as (select n_nationkey, n_regionkey::bigint as r from nation) select n_nationkey, r + 2 as twice, r + 10 as plus, [r + 1, r + 2] as pair, factorial((r + 3)::int)::bigint as fact, 0::bigint as deep, r * 2 + 1 as nested, [r + 1, r + 2] as many from t",
    ),
    "lookups_in_documents": (
        "nation",
        '.[] | [{k: 1, v: "one"}, {k: 2, v: "two"}] as $t | .n_regionkey as $r | {n_nationkey, index: ($t | INDEX(.k) | .["2"].v), index2: (INDEX($t[]; .v) | .one.k), join: ([{a: $r}] | JOIN(INDEX($t[]; .k); .a | tostring) | .[0][1].v), join3: ([JOIN(INDEX($t[]; .k); $r, 2; tostring)] | length), join4: ([JOIN(INDEX($t[]; .k); $r; tostring; .[1].v)][0]), in: ($r | IN(1, 2)), in2: IN($t[].k; $r, 9)}',
        "n_nationkey long, index string, index2 long, join string, join3 long, join4 string, in boolean, in2 boolean",
        "with t as (select n_nationkey, n_regionkey r from nation) select n_nationkey, 'two' as index, 1::bigint as index2, case r when 1 then 'one' when 2 then 'two' end as join, 2::bigint as join3, case r when 1 then 'one' when 2 then 'two' end as join4, r in (1, 2) as in, r in (1, 2) as in2 from t",
    ),
    "environment": (
        "nation",
        '.[] | {n_nationkey, env: (env | type), var: ($ENV | type), file: input_filename, line: input_line_number, decimals: have_decnum, literals: have_literal_numbers, many: (builtins | length > 200), named: (builtins | any(. == "map/1")), debug: (.n_regionkey | debug("seen") | debug), stderr: (.n_regionkey | stderr), args: ([$__loc__.line] | length), ends: ([try (input) catch .][0])}',
        "n_nationkey long, env string, var string, file string, line long, decimals boolean, literals boolean, many boolean, named boolean, debug long, stderr long, args long, ends string",
        "select n_nationkey, 'object' as env, 'object' as var, null::varchar as file, 0::bigint as line, true as decimals, false as literals, true as many, true as named, n_regionkey::bigint as debug, n_regionkey::bigint as stderr, 1::bigint as args, 'break' as ends from nation",
    ),
    "halting": ("nation", ".[] | .n_nationkey, halt, 1", "", "select n_nationkey::varchar as value from nation"),
    "inputs_all": ("nation", ".[] | [inputs] | length", "", "select '0' as value from nation"),
    "kinds_recursed": ("region", ".[] | ..", "", "select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as value from region union all select r_regionkey::varchar from region union all select '\"' || r_name || '\"' from region"),
    "optional_steps": ("nation", ".[] | .n_name | .x?, length", "", "select length(n_name)::varchar as value from nation"),
    "alternatives_of_patterns": ("nation", ".[] | [.n_regionkey, {a: .n_name}] as [$r, {a: $n}] ?// $r | \"\\($r)\\($n)\"", "", "select '\"' || n_regionkey || n_name || '\"' as value from nation"),
    "module_facts": ("nation", 'import "names" as n; .[] | "names" | modulemeta | .defs', "", "select '[\"tag/1\"]' as value from nation"),
    # the planner: null and false, orders, lookups and folds over whole tables
    "null_alternative": ("events", ".[] | {event_id, v: ((if .value > 400 then null elif .value > 300 then false else true end) // (.value < 350))}", "", "select event_id, case when value > 300 then value < 350 else true end as v from events"),
    "null_below_all": ("events", "map({event_id, x: (if .user_id % 2 == 0 then null else .value end)}) | map(select(.x < 100))  | length", "", "select count(*) as value from events where user_id % 2 = 0 or value < 100"),
    "null_comparisons": ("events", "map({event_id, x: (if .user_id % 2 == 0 then null else .value end)}) | .[] | {event_id, lt: (.x < 100), le: (.x <= 100), gt: (.x > 100), ge: (.x >= 100), eq: (.x == null)}", "", "select event_id, e or value < 100 as lt, e or value <= 100 as le, not e and value > 100 as gt, not e and value >= 100 as ge, e as eq from (select *, user_id % 2 = 0 as e from events)"),
    "null_sums": ("events", "map({u: .user_id, x: (if .user_id % 3 == 0 then null else .value end)}) | group_by(.u % 2) | map({u: (.[0].u % 2), mean: (map(.x) | add / length), least: (map(.x) | min == null)})", "", None),
    "null_addition": ("events", "map({event_id, x: (if .user_id % 2 == 0 then null else .value end)}) | .[] | {event_id, y: (.x + 1)}", "", "select event_id, round(case when user_id % 2 = 0 then 1 else value + 1 end, 4) as y from events"),
    "null_mean": ("events", "map({k: (.user_id % 2), x: (if .user_id % 3 == 0 then null else .value end)}) | group_by(.k) | map({k: .[0].k, mean: (map(.x) | add / length), low: (map(.x) | min)})", "", "select user_id % 2 as k, round(sum(case when user_id % 3 = 0 then null else value end) / count(*), 4) as mean, case when count(*) filter (where user_id % 3 = 0) = 0 then min(value) end as low from events group by 1"),
    "truthy_conditions": ("nation", ".[] | {n_nationkey, zero: (if .n_regionkey then 1 else 2 end), text: (if .n_name then 1 else 2 end), kept: ([.n_regionkey | select(.)] | array_length)}", "", "select n_nationkey, 1 as zero, 1 as text, 1 as kept from nation"),
    "update_alternative": ("events", "map({event_id, f: (if .value > 400 then null else .value > 200 end)}) | .[] | .f //= true", "", "select event_id, true as f from events"),
    "order_last_rows": ("orders", "sort_by(.o_orderkey) | .[-5:] | map(.o_orderkey)", "", "select o_orderkey as value from orders order by 1 desc limit 5"),
    "order_rest_rows": ("orders", "sort_by(.o_totalprice, .o_orderkey) | .[100:] | map(.o_orderkey)", "", "select o_orderkey as value from (select *, row_number() over (order by o_totalprice, o_orderkey) r from orders) where r > 100"),
    "order_middle_rows": ("orders", "sort_by(.o_orderkey) | .[10:-10] | length", "", "select greatest(count(*) - 20, 0) as value from orders"),
    "order_skip": ("customer", "sort_by(.c_custkey) | [skip(20; .[])] | length", "", "select greatest(count(*) - 20, 0) as value from customer"),
    "order_reverse": ("customer", "sort_by(.c_acctbal, .c_custkey) | reverse | .[:4] | map({c_custkey})", "", "select c_custkey from customer order by c_acctbal desc, c_custkey desc limit 4"),
    "order_last_nth": ("customer", "sort_by(.c_custkey) | last | {c_custkey}", "", "select max(c_custkey) as c_custkey from customer"),
    "order_nth": ("customer", "sort_by(.c_custkey) | nth(3) | {c_custkey}", "", "select c_custkey from customer order by 1 limit 1 offset 3"),
    "order_first_of_stream": ("customer", "sort_by(.c_custkey) | first(.[] | select(.c_acctbal > 5000)) | {c_custkey}", "", "select min(c_custkey) as c_custkey from customer where c_acctbal > 5000"),
    "order_unique_by_first": ("orders", "sort_by(-.o_totalprice, .o_orderkey) | unique_by(.o_orderpriority) | map({o_orderpriority, o_orderkey})", "", "select o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey from orders group by 1"),
    "table_isempty": ("orders", "isempty(.[] | select(.o_totalprice < 0))", "", "select count(*) = 0 as value from orders where o_totalprice < 0"),
    "table_any_generator": ("orders", "any(.[] | .o_totalprice; . > 400000)", "", "select bool_or(o_totalprice > 400000) as value from orders"),
    "table_add_stream": ("orders", "add(.[] | .o_custkey)", "", "select sum(o_custkey)::bigint as value from orders"),
    "table_max_object": ("orders", "map({o_custkey, o_orderkey}) | max", "", "select o_custkey, o_orderkey from orders order by 1 desc, 2 desc limit 1"),
    "table_groups": ("nation", "map(.n_name) | group_by(.[:1]) | map(length)", "", "select count(*) as value from nation group by left(n_name, 1)"),
    "fold_branches": ("lineitem", "reduce .[] as $r (0; if $r.l_linenumber % 2 == 0 then . + $r.l_quantity elif $r.l_linenumber == 1 then . - 1 else . end)", "", "select round(sum(case when l_linenumber % 2 = 0 then l_quantity when l_linenumber = 1 then -1 else 0 end), 4) as value from lineitem"),
    "fold_greatest": ("lineitem", "reduce .[] as $r (0; if $r.l_extendedprice > . then $r.l_extendedprice else . end)", "", "select round(max(l_extendedprice), 4) as value from lineitem"),
    "fold_running": ("orders", "sort_by(.o_orderkey) | [foreach .[] as $o (0; . + $o.o_custkey; {k: $o.o_orderkey, total: .})] | map(.)", "", "select o_orderkey as k, sum(o_custkey) over (order by o_orderkey rows unbounded preceding)::bigint as total from orders"),
    "lookup_index": ("orders", "INDEX($customer[]; .c_custkey) as $c | .[] | {o_orderkey, name: $c[.o_custkey | tostring].c_name}", "", "select o_orderkey, c_name as name from orders left join customer on o_custkey = c_custkey"),
    "lookup_join": ("orders", "JOIN(INDEX($customer[]; .c_custkey); .[]; .o_custkey | tostring; {k: .[0].o_orderkey, segment: .[1].c_mktsegment})", "", "select o_orderkey as k, c_mktsegment as segment from orders left join customer on o_custkey = c_custkey"),
    "lookup_in": ("customer", "map(select(.c_custkey | IN($orders[] | select(.o_totalprice > 400000) | .o_custkey)) | {c_custkey})", "", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)"),
    "lookup_not_in": ("customer", "map(select(.c_custkey | IN($orders[] | select(.o_totalprice > 400000) | .o_custkey) | not) | {c_custkey})", "", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)"),
    "share_of_total": ("nation", "length as $n | .[] | {n_nationkey, share: (.n_nationkey / $n)}", "", "select n_nationkey, round(n_nationkey / (select count(*) from nation)::double, 4) as share from nation"),
    "cross_product": ("region", ".[] | {k: .r_regionkey, v: ([0, 1, 2] as [$a, $b, $c] | [($a, $b, $c) + .r_regionkey])}", "k long, v array<long>", "select r_regionkey::bigint as k, [r_regionkey, r_regionkey + 1, r_regionkey + 2]::bigint[] as v from region"),
    "definitions_inlined": ("part", "def big: select(.p_size > 20); def cheap($x): select(.p_retailprice < $x); map(big) | .[] | {p_partkey, p_size}", "", "select p_partkey, p_size from part where p_size > 20"),
    "json_column": ("events", ".[] | {event_id, k: (.props | fromjson | .k | tojson)}", "", "select event_id, json_extract_string(props, '$.k') as k from events"),
}
del FAMILIES["null_sums"]
