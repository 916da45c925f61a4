"""Address lists in headers: names, comments, groups, quoted pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.encoded_words import decode_words
from mailveil.functions.folding import fold

ADDRESS_TYPE = "struct<name:string,email:string>"

# Pairs behind a backslash, characters with a meaning, white space, everything else.
TOKEN = r'(?s)\\.|[()<>,:;@"\[\]]|[ \t\r\n]++|[^\\()<>,:;@"\[\] \t\r\n]++|\\'

# One address without comments, groups, escapes and brackets: a bare one, or one in angles
# behind a name that is quoted as a whole or not at all.
PLAIN_NAME = r'(?:"[^"\\<>()]*+"|[^"\\<>(),:;@\[\]]*+)'
PLAIN_ITEM = (rf'[ \t]*+(?:{PLAIN_NAME}[ \t]*+<[^<>"\\(),:;\[\]\s]*+>|[^\s"\\<>(),:;\[\]]++)?+[ \t]*+')
PLAIN_LIST = rf"^{PLAIN_ITEM}(?:,{PLAIN_ITEM})*+$"
# One element of such a list: commas inside quotes do not split it.
LIST_ITEM = r'(?:[^",]++|"[^"]*+"?)++'

TEXT, QUOTED, LITERAL = 0, 1, 2


def split_plain(value: Column) -> Column:
    """The addresses of a list that ``PLAIN_LIST`` describes."""
    def one(item: Column) -> Column:
        before = F.btrim(F.regexp_extract(item, r"^([^<]*)<", 1), F.lit(" \t"))
        name = F.when(F.startswith(before, F.lit('"')), F.regexp_replace(before, r'^"|"$', "")
                      ).otherwise(F.regexp_replace(before, "[ \t]++", " "))
        angled = F.contains(item, F.lit("<"))
        return F.struct(
            F.when(angled, name).otherwise(F.lit("")).alias("name"),
            F.when(angled, F.regexp_extract(item, r"<([^>]*)>", 1)).otherwise(item).alias("email"))

    items = F.transform(F.regexp_extract_all(value, F.lit(LIST_ITEM), F.lit(0)),
                        lambda i: F.btrim(i, F.lit(" \t")))
    return F.transform(F.filter(items, lambda i: i != ""), one)


FIELDS = ("mode", "depth", "angle", "word", "phrase", "first", "spec", "has_at", "angled",
          "comments", "group")


def split_tokens(value: Column) -> Column:
    """The addresses of any list, read token by token.

    The state holds how deep in comments and where in quotes, brackets and angles a token
    stands, the words of a name, the address so far, and the comments.
    """
    none = F.array().cast(f"array<{ADDRESS_TYPE}>")
    empty = {
        "mode": F.lit(TEXT), "depth": F.lit(0), "angle": F.lit(False), "word": F.lit(""),
        "phrase": F.lit(""), "first": F.lit(None).cast("string"), "spec": F.lit(""),
        "has_at": F.lit(False), "angled": F.lit(None).cast("string"), "comments": F.lit(""),
        "group": F.lit(False),
    }

    def packed(values: dict[str, Column]) -> Column:
        return F.struct(*[values[f].alias(f) for f in FIELDS])

    def changed(s: Column, **new: Column) -> Column:
        return packed({f: new.get(f, s[f]) for f in FIELDS})

    def spaced(left: Column, right: Column) -> Column:
        return F.when(left == "", right).otherwise(F.concat(left, F.lit(" "), right))

    def unescaped(token: Column) -> Column:
        return F.when(F.startswith(token, F.lit("\\")), F.substr(token, F.lit(2))).otherwise(token)

    def literally(s: Column, token: Column) -> Column:
        """The token as a part of the address."""
        return changed(
            s, spec=F.when(s["angle"], s["spec"]).otherwise(F.concat(s["spec"], token)),
            angled=F.when(s["angle"], F.concat(s["angled"], token)).otherwise(s["angled"]))

    def worded(s: Column, word: Column, raw: Column) -> Column:
        """A word of a name, or of the address."""
        named = let(literally(s, raw), lambda n: changed(
            n, mode=F.lit(TEXT), word=F.lit(""),
            phrase=F.when(n["angled"].isNull(), spaced(n["phrase"], word)).otherwise(n["phrase"]),
            first=F.coalesce(n["first"], word)))
        inside = let(literally(s, raw), lambda n: changed(n, mode=F.lit(TEXT), word=F.lit("")))
        return F.when(s["angle"], inside).otherwise(named)

    def found(s: Column) -> Column:
        commented = F.concat(s["phrase"], F.lit(" ("), s["comments"], F.lit(")"))
        name = F.when(s["angled"].isNull(), s["comments"]).when(
            s["comments"] == "", s["phrase"]).otherwise(F.trim(commented))
        email = F.when(s["angled"].isNotNull(), s["angled"]).when(
            s["has_at"], s["spec"]).otherwise(s["first"])
        return F.when(email.isNotNull(), F.array(F.struct(
            name.alias("name"), email.alias("email")))).otherwise(none)

    def step(s: Column, t: Column) -> tuple[Column, Column]:
        # No name takes a comment behind its address, or before all else in a group.
        idle = s["angled"].isNotNull() | (s["group"] & (s["phrase"] == "") & (s["spec"] == ""))
        in_comment, blank = s["depth"] > 0, F.rlike(t, F.lit(r"^[ \t\r\n]"))
        ends = ((t == ",") & ~s["angle"]) | ((t == ";") & ~s["angle"])
        outside = (
            F.when(ends | ((t == ":") & ~s["angle"] & ~s["has_at"]), packed(
                empty | {"group": (t == ":") | ((t == ",") & s["group"])}))
            .when(t == "(", changed(s, depth=F.lit(1), word=F.lit("")))
            .when(t == '"', changed(s, mode=F.lit(QUOTED), word=F.lit("")))
            .when(t == "[", let(literally(s, t), lambda n: changed(n, mode=F.lit(LITERAL))))
            .when(t == "<", changed(s, angle=F.lit(True), angled=F.lit("")))
            .when(t == ">", changed(s, angle=F.lit(False)))
            .when((t == ":") & s["angle"], changed(s, angled=F.lit("")))
            .when(t == "@", let(literally(s, t), lambda n: changed(
                n, has_at=n["has_at"] | ~n["angle"])))
            .when(blank | t.isin(")", "]", ",", ";", ":"), s)
            .otherwise(worded(s, t, t)))
        commented = (
            F.when(t == "(", changed(s, depth=s["depth"] + 1))
            .when((t == ")") & (s["depth"] > 1), changed(s, depth=s["depth"] - 1))
            .when(t == ")", changed(s, depth=F.lit(0), word=F.lit(""), comments=F.when(
                idle, s["comments"]).otherwise(spaced(s["comments"], s["word"]))))
            .otherwise(changed(s, word=F.concat(s["word"], unescaped(t)))))
        quoted = F.when(t == '"', worded(
            s, s["word"], F.concat(F.lit('"'), F.regexp_replace(s["word"], r'(["\\])', r"\\$1"),
                                   F.lit('"')))
                        ).otherwise(changed(s, word=F.concat(s["word"], unescaped(t))))
        bracketed = let(literally(s, t), lambda n: changed(
            n, mode=F.when(t == "]", F.lit(TEXT)).otherwise(n["mode"])))
        after = (F.when(in_comment, commented).when(s["mode"] == QUOTED, quoted)
                 .when(s["mode"] == LITERAL, bracketed).otherwise(outside))
        closes = ~in_comment & (s["mode"] == TEXT) & ends
        return after, F.when(closes, found(s)).otherwise(none)

    tokens = F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))
    return let(fold(tokens, packed(empty), none, step), lambda r: F.concat(
        r["out"], found(r["state"])))


def split_list(value: Column) -> Column:
    """The addresses of one header value, in order, names decoded.

    As the standard library's parser has it: a comment names a bare address, and follows the
    name of one in angles if it stands before these; members of a group count, its name does
    not; of words without an address the first is taken for one. An empty comment is none. Of
    null there are none.
    """
    found = F.when(F.rlike(value, F.lit(PLAIN_LIST)), split_plain(value)).otherwise(
        split_tokens(value))
    return F.transform(found, lambda a: F.struct(
        decode_words(a["name"]).alias("name"), a["email"].alias("email")))


def parse_addresses(values: Column) -> Column:
    """Header values as ``array<struct<name, email>>``, in order."""
    return F.flatten(F.transform(values, split_list))
