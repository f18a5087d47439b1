"""Problem 9: template fields left open, filler text, and pages that are errors or notices.

Segments of many documents that agree around a differing part are aligned to templates; the differing part is a
slot. A first scan takes up what looks like an open field, a bare variable name, a default or a gap, with up to three
tokens on each side as its template, and pages of messages with their sentences as templates. A second scan finds
what all other documents have in these slots, ordinary content or nothing. How something looks only proposes it:
a document is a case where the alignment confirms it, that is, where the slot has other contents elsewhere, the
filler's word pairs stand in two documents, or two documents have the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.plans.runtime import materialize, spread

FENCE = re.compile(r"```[\s\S]*?(?:```|\Z)")
INLINE = re.compile(r"`[^`\n]{1,200}`")
QUOTED = re.compile(r"""(?<!\w)'[^'\n]{1,80}'(?!\w)|"[^"\n]{1,120}"|[“„«][^”“»\n]{1,120}[”“»]|[「『][^」』\n]{1,80}[」』]""")
QUOTE = re.compile("['\"“„«「『]")
#: What every open field has at least one of.
SIGN = re.compile(r"[{<\[@%#$]|__|\((?i:add|insert|fill in|enter) ")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+")
_NAME = r"[A-Za-z][A-Za-z0-9_.-]*(?: [A-Za-z][A-Za-z0-9_.-]*){0,3}"
#: Forms of an open field.
FIELD = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|@@{_NAME}@@"
    rf"|<(?:your|insert|enter|add) {_NAME}>|\[(?:INSERT|ENTER|YOUR|ADD|TODO)[ :_]{_NAME}\]|\((?:add|insert|fill in|enter) {_NAME} (?:later|here)\)"
    r"|\[\[\s*[A-Za-z_][\w ]*\]\]|(?<![\w{$])\{[A-Za-z_]\w*\}|(?<!\w)__[A-Za-z][A-Za-z0-9_]*__(?!\w)|(?<!\w)%[A-Za-z][A-Za-z0-9_]+%(?!\w)|(?<!\w)#[A-Za-z][A-Za-z0-9_]+#(?!\w)|_{4,}",
    re.I)
DEFAULT = re.compile(r"(?:tbd|todo|fixme|x{3,}|\?{3,}|to be (?:added|filled in|written|done|announced)|coming soon|(?:your|insert|enter)\b.{0,40}\bhere|placeholder)[.!]?", re.I)
#: Defaults within a sentence, capitals alone as small letters are words of languages, or as all that follows a colon.
STAND_INS = ("TBD", "TODO", "FIXME", "XXX")
STAND_IN = re.compile(r"(?<![\w{$#%<\[@./-])(?:TBD|TODO|FIXME|X{3,})(?![\w(}#%>\]@-]|\s*:)")
STATED = re.compile(rf"(?<=[:：])\s*(?:{DEFAULT.pattern})\s*\Z", re.I)
LABEL = re.compile(r"[^\w]{0,12}([^\W\d_a-z][^\W\d_]+(?: [^\W\d_]+){0,2}) ?[:：]\s*(.*)")
#: A sentence with one of these speaks about such fields.
ABOUT = re.compile(r"\b(?:macros?|predefined|placeholders?|templates?|syntax|prints?|printf|logger|escaped?|variables?|fill in|filled|fills|directive|modulo)\b", re.I)
#: The usual filler words; the vocabulary is widened from the corpus.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split())
LOREM = re.compile(r"\blorem ipsum\b", re.I)
#: A bare variable name, and signs that something is left blank; both count only beside two different contents.
BARE = re.compile(r"(?<![\w{$#%<\[@.])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?![\w(}#%>\]@])")
BLANK = re.compile(r"(?<=[,:])(?=\s*[.!?](?:\s|$))|(?<=\w)\s+(?=[.,!?](?:\s|$))|(?<=\w )(?= +\w)")
#: Words that messages of sites are made of, in ten languages: what they are about, what is the matter with
#: it, what the reader must have or do, and parts of a browser.
THING = re.compile(
    r"\b(?:pages?|sites?|websites?|shaders?|entr(?:y|ies)|items?|records?|documents?|files?|requests?|sessions?|access|accounts?|servers?|gateway|network|permission|service|preview|content"
    r"|seiten?|eintr[aä]ge?|zugriff|sitzung|dienst|inhalte?s?|anfragen?|accès|contenu|demandes?|serveur|página|acceso|sesión|contenido|servidor|acesso|sessão|conteúdo|pagin[ae]|accesso|sessione|contenut[oi]|stron\w+|dostęp\w*|sesj\w+|treś\w+)\b"
    r"|страниц|доступ|сесси|сервер|запрос|содержим|шейдер|页面|网页|访问|内容|请求|会话|着色器|ページ|アクセス|サーバ|リクエスト|コンテンツ|セッション", re.I)
STATE = re.compile(
    r"\b(?:errors?|not found|denied|forbidden|unauthori[sz]ed|unavailable|not available|expired|timed[ -]?out|time-?out|removed|deleted|(?:does(?: not|n't)|no longer) exists?|missing|fail(?:ed|s|ure)|could(?: not|n't) be|cannot be|can't be"
    r"|too many|went wrong|maintenance|not allowed|bad|internal|fehler|nicht (?:gefunden|verfügbar|erreichbar)|verweigert|abgelaufen|gelöscht|verschoben|wartung\w*|erreur|introuvable|refusé|interdit|expirée?|indisponible"
    r"|no se (?:pudo|puede|encontró)|no (?:encontrad[ao]|existe|disponible)|denegado|caducad[ao]|não (?:encontrad[ao]|existe|disponível|foi possível)|negado|expirou|erro|errore|non (?:trovat[ao]|esiste|disponibile)|negato|scadut[ao]|impossibile"
    r"|nie (?:znaleziono|istnieje|można|udało)|odmowa|błąd|wygasła)\b|ошибк|не найден|не существует|запрещ|недоступ|истекл|удал[её]н|不存在|找不到|被?删除|错误|拒绝|无法|过期|失败|見つかりません|存在しません|エラー|拒否|できません|失敗|期限切れ", re.I)
BROWSER = re.compile(r"\b(?:javascript|scripts?|cookies?|browsers?|webgl|captcha|robot|noscript|skripte?|navigateur|navegador|przeglądark\w+|skrypty?)\b|браузер|скрипт|浏览器|脚本|ブラウザ|スクリプト|クッキー", re.I)
NEED = re.compile(
    r"\b(?:enabled?|activate|allow(?:ed)?|(?:turn|switch)(?:ed)?\b[^.!?]{0,20}\b(?:on|off)|check(?:s|ing)?|must|requires?d?|needs?|disabled|blocked|accept|supported?|outdated|verify|aktivieren|aktiviere|erlauben|active[rz]|accepte[rz]|activ[ae]r?|habilit[ae]r?|acept[ae]r?"
    r"|ative|aceite|attiva(?:re)?|abilita(?:re)?|accetta|włącz\w*|zezw\w+)\b|включите|разрешите|启用|允许|接受|有効|許可", re.I)
AGAIN = re.compile(r"\b(?:come back|try again|reload|sign in|log in|wait a moment|erneut|réessayez|inténte\w+|tente novamente|riprova|spróbuj)\b|попробуйте|重试|再試行|再度", re.I)
STATUS = re.compile(rf"(?:error|fehler|erreur|errore|erro|błąd|ошибка)[ :-]{{0,2}}[45]\d\d\b|(?<![\w(])[45]\d\d[ :-]{{1,2}}(?:{STATE.pattern}|{THING.pattern})", re.I)
#: Code, which holds names and gaps of its own.
CODE = re.compile(r"[;{}=<>]|\w\(|//|\A\d+\(")
#: Every message has one of these parts, in lower case; _ is a space.
PARTS = tuple(w.replace("_", " ") for w in (
    "error not_found denied forbidden authori unavailable not_available expire timed time-out timeout remove delete not_exist n't_exist longer_exist missing fail could_not_be couldn't_be cannot_be can't_be too_many went_wrong maintenance not_allowed bad internal "
    "fehler nicht_gefunden nicht_verfügbar nicht_erreichbar verweigert abgelaufen gelöscht verschoben wartung erreur introuvable refus interdit indisponible no_se_ no_encontrad no_existe no_disponible deneg caduc não_ negad expir erro "
    "non_trovat non_esiste non_disponibile negat scadut imposs nie_znaleziono nie_istnieje nie_można nie_udało odmowa błąd wygas ошибк не_найден не_существует запрещ недоступ истек удал 不存在 找不到 删除 错误 拒绝 无法 过期 失败 見つ 存在しません エラー 拒否 できません "
    "失敗 期限 script cookie browser webgl captcha robot skript navigateur navegador przegl skrypt браузер скрипт 浏览器 脚本 ブラウザ クッキー スクリプト "
    "come_back try_again reload sign_in log_in wait_a_moment erneut réessay intént tente riprova spróbuj попробуй 重试 再試行 再度").split())
WORDS = re.compile("|".join((THING.pattern, BROWSER.pattern, STATE.pattern)), re.I)
WORDS = re.compile(r"[^\W\d_]+")
WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]{4}")
MARKUP = re.compile(r"<(?:style|script)\b[\s\S]*?</(?:style|script)>|<!--[\s\S]*?-->|<[^<>]{1,500}>", re.I)
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Words on each side that make a template, and tokens within a sentence that a slot holds at most.
SIDE, WIDEST = 3, 8
#: Bits of the set of templates that is sent to all tasks: of fixed size, what it passes is joined exactly.
BITS = 1 << 22
#: Stands for the token before the first.
NOTHING = 0


def key64(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def segments(text: str) -> list[str]:
    """Sentences and lines outside code quotes."""
    if "`" in text:
        text = INLINE.sub(" ", FENCE.sub("\n", text))
    return [s for s in (p.strip() for p in SENTENCE.split(text)) if s]


def unquoted(text: str) -> str:
    return QUOTED.sub(" ", text) if QUOTE.search(text) else text


def before(tokens: list[str], at: int) -> tuple[str, ...]:
    """Up to SIDE tokens left of ``at``; beyond the nearest only words, so what precedes a template is left out."""
    first = at
    while first > max(0, at - SIDE) and (first == at or tokens[first - 1][0].isalnum()):
        first -= 1
    return tuple(tokens[first:at])


def template(left: tuple[str, ...], right: tuple[str, ...], whole: bool = False) -> int | None:
    """Key of a slot between these tokens; None if fewer than two words (a colon before it is one) tell it. One is
    enough if the tokens are the ``whole`` rest of the sentence."""
    told = sum(t[0].isalnum() for t in left + right) + (left[-1:] == (":",)) + whole
    return key64("slot\0" + " ".join(left) + "\0" + " ".join(right)) if told >= 2 else None


def field_slot(bare: str, start: int, end: int) -> tuple[tuple[str, ...], int | None]:
    """Tokens before the field, and key of its template."""
    tokens, after = TOKEN.findall(bare[:start]), TOKEN.findall(bare[end:])
    left = before(tokens, len(tokens))
    return left, template(left, tuple(after[:SIDE]), len(left) == len(tokens) and len(after) <= SIDE)


def contents(text: str, last: bytes, lefts: bytes, slots: bytes) -> Iterator[tuple[int, int, bool]]:
    """(template key, fill key, blank) of all parts of a text that stand between the tokens of a template.

    What looks like a field itself is no content. The templates come as bit sets of fixed size.
    """
    parts = segments(text)
    for k, s in enumerate(parts):
        tokens = TOKEN.findall(unquoted(s))
        for at in range(len(tokens) + 1):
            if not has(last, hash_of(tokens[at - 1]) if at else NOTHING) or not has(lefts, hash_of(" ".join(left := before(tokens, at)))):
                continue
            for end in {*range(at, min(at + WIDEST, len(tokens)) + 1), len(tokens)}:
                right = tuple(tokens[end : end + SIDE])
                key = template(left, right, len(left) == at and end + len(right) == len(tokens))
                if key is not None and has(slots, key % BITS):
                    blank = end == at
                    if blank and not at:
                        continue
                    if blank and end == len(tokens) and not (k + 1 == len(parts) or LABEL.fullmatch(parts[k + 1])):
                        continue  # a heading, its content follows
                    own = "".join(tokens[at:end])
                    if blank or not (FIELD.search(own) or BARE.search(own) or DEFAULT.fullmatch(" ".join(tokens[at:end]))):
                        yield key, key64(own), blank


def has(bits: bytes, at: int) -> bool:
    return bits[at >> 3] >> (at & 7) & 1 == 1


@lru_cache(1 << 16)
def hash_of(word: str) -> int:
    return key64(word) % BITS


def is_message(s: str) -> bool:
    """A sentence that says what is the matter with a page, or what the reader's browser needs."""
    low = s.lower()
    if not any(w in low for w in PARTS):
        return False
    state, browser = STATE.search(s), BROWSER.search(s)
    if state:
        return bool(browser or THING.search(s) or AGAIN.search(s) or STATUS.search(s))
    return bool((browser and NEED.search(s)) or (AGAIN.search(s) and THING.search(s)))


def message_keys(text: str, parts: list[str] | None = None) -> set[int]:
    """Template keys of a page of messages; none if fewer than half of its sentences are messages.

    Marks of HTML, and titles, links and footers of under four words, do not count. The words of all messages, those
    with digits masked, are the template; so are they without the first or last one or two, and wide letters alone, as
    people put things around them. ``parts`` are the text's segments if they are known.
    """
    if parts is None or "<" in text:
        parts = segments(MARKUP.sub("\n", text) if "<" in text else text)
    whole = "\n".join(parts).lower()
    if not QUOTE.search(whole) and not any(w in whole for w in PARTS):
        return set()  # a quotation taken out may join the words around it, so such texts are read
    messages: list[str] = []
    others = 0
    for s in parts:
        bare = unquoted(s)
        if is_message(bare):
            messages.append(bare)
        elif len(s.split()) >= 4 or WIDE.search(s):
            others += 1
            if 2 * others > len(parts):
                return set()
    if len(messages) < max(1, others):
        return set()
    words = page_words(" ".join(messages))
    wide = re.findall(r"[぀-ヿ㐀-䶿一-鿿]", "".join(words))
    forms = [words, *([words[1:], words[:-1]] if len(words) > 2 else []), *([words[2:], words[:-2]] if len(words) > 4 else []), *([wide] if len(wide) >= 5 else [])]
    return {key64("page\0" + "".join(w)) for w in forms if w}


def page_words(sentence: str) -> list[str]:
    return WORDS.findall(re.sub(r"\w*\d\w*", "0", sentence.lower()))


def filler_part(tokens: list[str], own: int, filler: frozenset[str]) -> set[tuple[str, str]]:
    """Word pairs of the filler in a sentence whose last ``own`` words follow its label, if it has one.

    All pairs if most words are filler. Else those of runs of five words on, which hold the usual phrase or are the
    usual words alone, and of any run with the phrase that is all there is.
    """
    if len(tokens) >= 4 and sum(w in filler for w in tokens) >= 0.8 * len(tokens):
        return set(zip(tokens, tokens[1:]))
    pairs: set[tuple[str, str]] = set()
    run: list[str] = []
    for w in [*tokens[len(tokens) - own :], ""]:
        if w in filler:
            run.append(w)
            continue
        told = set(zip(run, run[1:]))
        if ("lorem", "ipsum") in told and len(run) >= min(5, own) or len(run) >= 5 and LATIN.issuperset(run):
            pairs |= told
        run = []
    return pairs


def evidence(doc_id: int, text: str, filler: frozenset[str]) -> list[tuple[str, int, int]]:
    """(kind, template key, fill key) of everything in a text that may make it a case.

    Kinds: 'open' field or default in a slot, 'copy' the same with its field as part of the template and the text as
    fill, 'bare' variable name or gap in a slot, 'fill' ordinary content of a labelled slot, 'blank' none, 'slot' a
    template to look for elsewhere, 'left' the token and the tokens before it, 'filler' pair of words of filler and 'page'
    message or lone default, both with the document as fill. In a sentence that speaks about fields a field counts like
    a bare name, and only if none of the words that say so are in its template.
    """
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    filled = not filler.isdisjoint(WORDS.findall(low))
    signed, bared = SIGN.search(text) is not None, BARE.search(text) is not None or BLANK.search(text) is not None
    stood = any(w in text for w in STAND_INS)
    parts = segments(text)
    for k, s in enumerate(parts if signed or bared or filled or stood or ":" in text or "：" in text else []):
        label = LABEL.fullmatch(s) if ":" in s or "：" in s else None
        slot = key64("label:" + label[1]) if label else None
        got = False
        forms = [("open", FIELD)] if signed and SIGN.search(s) else []
        if bared and not CODE.search(s):
            forms += [("bare", BARE), ("bare", BLANK)]
        if stood and STAND_IN.search(s) and not CODE.search(s):
            forms.append(("bare", STAND_IN))
        if label is None and (":" in s or "：" in s) and STATED.search(s) and not CODE.search(s):
            forms.append(("bare", STATED))
        if forms:
            bare = unquoted(s)
            about = ABOUT.search(FIELD.sub(" ", s)) is not None
            for kind, form in forms:
                if about and form is not FIELD:
                    continue
                for m in form.finditer(bare):
                    field = key64("".join(m.group().split()))
                    left, key = field_slot(bare, m.start(), m.end())
                    right = tuple(TOKEN.findall(bare[m.end() :])[:SIDE])
                    if about:
                        if ABOUT.search(" ".join(left + right)):
                            continue
                        kind = "bare"
                    if slot is not None and kind == "open":
                        out.append((kind, slot, field))
                        got = True
                    if kind == "open":  # open fields may tell each other by less
                        out += [(kind, near, field) for near in (template(left[-1:], right[:1], True), template((), right)) if near is not None]
                    if key is not None:
                        out += [(kind, key, field), ("slot", key, field), ("left", hash_of(left[-1]) if left else NOTHING, hash_of(" ".join(left)))]
                        if kind == "open":
                            out.append(("copy", key64(f"copy\0{key}\0{field}"), key64(text)))
        if label and not got:
            own = label[2].strip()
            if own or k + 1 == len(parts) or LABEL.fullmatch(parts[k + 1]):  # else a heading, its content follows
                out.append(("open" if DEFAULT.fullmatch(own) else "fill" if own else "blank", slot, key64(own)))
        if filled:
            tokens = [w.lower() for w in WORDS.findall(unquoted(s))]
            if pairs := filler_part(tokens, len(WORDS.findall(unquoted(label[2]))) if label else len(tokens), filler):
                out += [("filler", key64(f"filler\0{a}\0{b}"), doc_id) for a, b in pairs]
    if DEFAULT.fullmatch(text.strip()):
        out.append(("page", key64("default\0" + text.strip().lower()), doc_id))
    out += [("page", key, doc_id) for key in message_keys(text, parts)]
    return out


def filler_words(documents: DataFrame, most: int = 100_000) -> frozenset[str]:
    """Words of sentences that begin or go on from the usual filler phrase, outside quotes, in two sentences or more.

    Refused beyond ``most`` words: a vocabulary of filler that large would be the language's own.
    """

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for s in segments(text):
                    bare = QUOTED.sub(" ", s)
                    if (m := LOREM.search(bare)) and m.start() <= 12 and len(tail := WORDS.findall(bare[m.start() :])) >= 5:
                        seen.update({w.lower() for w in tail})
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    rows = (
        documents.filter(F.col("text").rlike("(?i)lorem ipsum")).select("text").mapInPandas(seeds, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2").limit(most + 1).collect()
    )
    if len(rows) > most:
        raise ValueError(f"more than {most} words of filler")
    return LATIN | {r[0] for r in rows}


def bit_set(values: DataFrame) -> bytes:
    """The set of a column ``b`` of numbers below BITS: built in Spark, of BITS / 8 bytes whatever the number of rows."""
    # positions are 1-based within buckets of 32,768 bits
    rows = values.groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("bits")).collect()
    out = bytearray(BITS >> 3)
    for k, bits in rows:
        out[(k - 1) * 4096 : k * 4096] = bits
    return bytes(out)


SIGNS = "doc_id long, kind string, key long, fill long"


def table_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "kind": [r[1] for r in rows], "key": [r[2] for r in rows], "fill": [r[3] for r in rows]})


def ends(pairs: set[tuple[int, int]], kind: str) -> list[tuple]:
    """Rows of the least and the greatest fill of each key: all that a task tells of ordinary content."""
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for key, fill in pairs:
        low[key], high[key] = min(fill, low.get(key, fill)), max(fill, high.get(key, fill))
    return [(None, kind, k, f) for bound in (low, high) for k, f in bound.items()]


def found(documents: DataFrame) -> DataFrame:
    """p9_found: (doc_id). Null, empty and blank texts are no cases; neither is anything that no other text confirms.

    Slots are aligned over all documents. Only least and greatest content of a template are kept, so a template in
    a third of all texts stays cheap.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filler_words(documents))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filler = shared.value
        for batch in batches:
            rows, fills = [], set()
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for kind, key, fill in evidence(doc_id, text, filler):
                    if kind != "fill":
                        rows.append((doc_id, kind, key, fill))
                    else:
                        fills.add((key, fill))
            rows += ends(fills, "fill")
            if rows:
                yield table_of(rows)

    texts = spread(documents.filter(F.length(F.trim("text")) > 0).select("doc_id", "text"))
    signs = materialize(texts.mapInPandas(scan, SIGNS))
    slots, lefts = signs.filter("kind = 'slot'"), signs.filter("kind = 'left'")
    if not slots.isEmpty():
        known = documents.sparkSession.sparkContext.broadcast((bit_set(lefts.select(F.col("key").alias("b"))), bit_set(lefts.select(F.col("fill").alias("b"))), bit_set(slots.select(F.pmod("key", F.lit(BITS)).alias("b")))))

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows, own = [], set()
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    for key, fill, blank in contents(text, *known.value):
                        if blank:
                            rows.append((doc_id, "gap", key, fill))
                        else:
                            own.add((key, fill))
                rows += ends(own, "fill")
                if rows:
                    yield table_of(rows)

        fitted = texts.mapInPandas(fit, SIGNS).join(slots.select("key").distinct(), "key", "left_semi").select("doc_id", "kind", "key", "fill")
        signs = signs.unionByName(materialize(fitted))
    ordinary = F.when(F.col("kind") == "fill", F.col("fill"))
    stats = signs.filter("kind not in ('left', 'slot')").groupBy("key").agg(
        (F.min("fill") < F.max("fill")).alias("differs"), F.coalesce(F.min(ordinary) < F.max(ordinary), F.lit(False)).alias("varied"), F.coalesce(F.bool_or(F.col("kind") == "open"), F.lit(False)).alias("fielded"))
    doubtful = signs.filter("kind not in ('left', 'slot', 'fill')").select("doc_id", "kind", "key").distinct()
    # a gap or a bare name is one beside a field or two ordinary contents
    sure = F.when(F.col("kind").isin("bare", "gap"), F.col("varied") | (F.col("fielded") & F.col("differs"))).otherwise(F.col("differs"))
    return doubtful.join(stats.filter("differs"), "key").filter(sure).select("doc_id").distinct()


def clean(documents: DataFrame) -> DataFrame:
    """The documents without the cases, all columns unchanged."""
    return documents.join(found(documents), "doc_id", "left_anti")
