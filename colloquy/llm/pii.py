"""Problem 10: personal data in free text, found and replaced by marks of its type.

A semi-Markov conditional random field over a document: entities are whole spans
of bounded length, each scored by features of the whole span (form, lexicon,
neighbours), everything else scores zero, and dynamic programming picks the best
set of spans that do not overlap, boundaries and types together. The lattice holds
every span that has the form of an entity, for names every run of two to four
capitalised words and every Han surname with one or two characters. The weights
maximise the likelihood of a bounded labelled sample below, its normaliser summed
over the lattice, under a Gaussian prior about zero. A first pass over all documents counts which words stand
as given names (which characters in Han names) where the context leaves no doubt.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import durable

TYPES = ("email", "phone", "id_number", "street_address", "name")
#: Characters in the longest entity that decode() takes by default, and parts of a personal name.
LONGEST, PARTS = 120, 4
#: Most names of a counted lexicon that are sent to the workers; a larger one is joined with the words of the texts.
LEXICON = 100_000

# Letters of Latin names, accented ones included.
_UP = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isupper())
_LOW = "a-z" + "".join(c for c in map(chr, range(0xC0, 0x180)) if c.islower())
_W = f"{_UP}{_LOW}0-9"

# Forms of addresses, numbers and names.
_TOP = r"(?:com|org|net|edu|gov|mil|int|info|biz|io|co|me|tw|uk|us|de|fr|jp|example|test|invalid|local)"
_EMAIL = re.compile(
    rf"[{_W}_%+-]+(?:\.[{_W}_%+-]+)* ?(?:@|＠) ?[{_W}-]+(?:\.[{_W}-]+)+"
    rf"|[{_W}_+-]+(?:(?:\.| dot )[{_W}_+-]+)* ?[(\[{{<] ?(?:at|AT) ?[)\]}}>] ?[{_W}-]+(?:(?: ?[(\[{{<] ?(?:dot|DOT) ?[)\]}}>] ?|\.| dot )[{_W}-]+)+"
    rf"|(?<![\w.])[{_W}_+-]+(?:(?: dot | DOT |\.)[{_W}_+-]+)* (?:at|AT) (?:[{_W}-]+ (?:dot|DOT) )+(?i:{_TOP})(?![A-Za-z0-9])"
)
_EXT = r"(?:,? ?(?:ext\.?|extension|x|分機|轉) ?\d{1,5})?"
_PHONE = re.compile(
    rf"(?<![A-Za-z0-9_+/$.-])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,5}}(?:[ .-]\d{{2,6}}){{0,4}}|\(\d{{2,4}}\) ?\d{{3,4}}[ .-]?\d{{3,4}}"
    rf"|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|0\d{{1,3}}[ -]\d{{3,4}}[ -]\d{{3,4}}|09\d{{2}}[ -]?\d{{3}}[ -]?\d{{3}}|1[2-9]\d{{9}}|0\d{{9,10}}|[2-9]\d{{2}}[2-9]\d{{6}}){_EXT}(?:(?=\d{{1,2}}月)|(?![A-Za-z0-9_-]|\.\d))"
)
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|nought|double|triple)"
_SPOKEN = re.compile(rf"(?<![A-Za-z])(?:plus )?{_DIGIT}(?:[ ,-]+{_DIGIT}){{5,18}}(?![A-Za-z])|[零〇一二三四五六七八九](?:[，、 \-－]?[零〇一二三四五六七八九]){{6,18}}", re.I)
_ID = re.compile(
    r"(?<![A-Za-z0-9_$.+-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{1,3}-\d{6,10}|[A-Z]{2} \d{3} \d{3}|[A-Z]{1,2}\d{6,10}|[A-Z]\d-\d{4}-\d{4}|[A-Z]\d{1,3}(?:-\d{2,5}){1,3}|[A-Z]{2}(?: \d{2}){3} [A-Z]|\d{2}-\d{7}|\d{8,10})(?![A-Za-z0-9_-]|\.\d)"
)
_SUFFIX = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Terrace|Ter|Way|Drive|Dr|Boulevard|Blvd|Place|Pl|Square|Sq|Close|Crescent|Cres|Row|Alley|Highway|Hwy|Parkway|Pkwy|Circle|Trail|Quay|Walk)"
_TENS = r"(?:(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|oh|and)[ -])"
_STREET = re.compile(
    rf"(?<![\w$.,:/-])(?:\d{{1,5}}[A-Za-z]?(?:-\d{{1,4}})?|(?i:{_TENS}{{1,6}})(?<=[ -]))\s?(?:(?:North|South|East|West|N\.|S\.|E\.|W\.) )?(?:[A-Z][a-z]+(?:'s)? ){{1,3}}{_SUFFIX}(?![a-z])\.?"
    rf"(?:,? (?:Unit|Apt|Apartment|Suite|Ste|Flat|Floor|Room|#)\.? ?[\w-]+)?(?:, (?:[A-Z][a-z]+ )?[A-Z][a-z]+(?![a-z]))?"
)
_NUM = r"(?:\d{1,5}|[零〇一二三四五六七八九十百千]{1,7})"
_STREET_HAN = re.compile(rf"[一-鿿]{{2}}[市縣](?:[一-鿿]{{1,3}}[區鄉鎮市])?[一-鿿]{{1,5}}(?:路|街|大道)(?:[一二三四五六七八九十\d]{{1,2}}段)?(?:{_NUM}巷)?(?:{_NUM}弄)?{_NUM}號(?:之{_NUM})?(?:，?{_NUM}樓)?(?:之{_NUM})?(?:{_NUM}室)?")
_CAP = rf"[{_UP}](?:[{_LOW}]+|[{_LOW}]*['’][{_UP}][{_LOW}]+|[{_LOW}]+[{_UP}][{_LOW}]+)(?:-[{_UP}][{_LOW}]+)?"
_PARTICLE = r"(?:d[aeiou]s?|del|della|de la|van|van der|van den|von|von der|zu|ten|ter|bin|ibn|al|el|le|la|af|av|y)"
_CHAIN = re.compile(rf"{_CAP}(?:(?: [{_UP}]\.?)? (?:{_PARTICLE} )?{_CAP})+(?![\w@]|['’][a-rt-z]|-\w)")
_PART = re.compile(rf"({_CAP})|([{_UP}])\.?(?= )|({_PARTICLE})(?= )")
_NAME_BACK = re.compile(rf"({_CAP}), ({_CAP})(?: [{_UP}]\.)?(?![\w@-])")
_NAME_UPPER = re.compile(rf"([{_UP}]{{2,}}) (?:[{_UP}]\. )?([{_UP}]{{3,}}(?:-[{_UP}]{{3,}})?)(?![\w@-])")
_JOINED = frozenset("'@.+-_")


def _joined(text: str, at: int) -> bool:
    """Whether a word goes on before this place."""
    return at > 0 and (text[at - 1].isalnum() and ord(text[at - 1]) < 0x2E80 or text[at - 1] in _JOINED)


Name = tuple[int, int, str, str, tuple[str, ...], bool, bool]


def name_forms(text: str) -> Iterator[Name]:
    """(start, end, first, last, words between, with initial, with particle) of every run of two to PARTS capitalised words that may be a name."""
    for m in _CHAIN.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        words = [k for k, p in enumerate(parts) if p.group(1)]
        for n, i in enumerate(words):
            first = parts[i].group(1)
            if first in _NOT or first.split("-")[0] in _NOT or n == 0 and _joined(text, m.start()):
                continue
            between: tuple[str, ...] = ()
            for j in words[n + 1 : n + PARTS]:
                last = parts[j].group(1)
                if last in _NOT or last.split("-")[0] in _NOT:
                    break
                inner = parts[i + 1 : j]
                yield parts[i].start(), parts[j].end(), first, last, between, any(p.group(2) for p in inner), any(p.group(3) for p in inner)
                between = (*between, last)


# A run of digits long enough to be a number of interest; the full patterns are tried around these only.
_DIGITS = re.compile(r"[0-9][0-9 ().-]{4,}[0-9]")
_HOUSE = re.compile(r"[0-9]+[A-Za-z]?(?:-[0-9]+)? [A-Z]")
_SPOKEN_SIGNS = (" one", " two", " three", " four", " five", " six", " seven", " eight", " nine", " oh", " zero", " double")
_SPOKEN_HOUSE = ("hundred", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "teen ", "eleven ", "twelve ")
_HONORIFIC = re.compile(r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam|Rev|Hon)\.? $")
# Words that make a capitalised pair something else than a person.
_ROLES = frozenset("Analyst Assistant Attorney Auditor Chair Chairman Chairwoman Chairperson Chancellor Chief Clerk Commissioner Consultant Coordinator Councillor Counsel Dean Deputy Designer Developer Director Editor Engineer Executive Foreman Governor Guard Head Inspector Instructor Intern Judge Lead Librarian Manager Mayor Member Minister Nurse Officer Operator Owner Partner Planner President Principal Producer Professor Ranger Representative Researcher Scientist Secretary Senator Sergeant Specialist Steward Supervisor Surveyor Teacher Technician Trainer Treasurer Trustee Warden Worker".split())
_THINGS = frozenset("Academy Agency Annex Archive Association Authority Bank Bay Board Branch Bridge Bureau Campus Center Centre Church City Club College Committee Company Corporation Council County Department Depot District Falls Fleet Forum Foundation Fund Garden Group Hall Harbor Hill Hospital House Inc Institute Island Lab Labs Lake Library Limited Ltd Market Mill Ministry Museum Office Park Partners Pavilion Point Port Press Project Province River School Section Series Service Services Shed Society State Station Studio Systems Team Terminal Theater Tower Town Trust Union University Upper Lower Valley Village Workshop Yard".split()) | frozenset(_SUFFIX[3:-1].split("|"))
_WHEN = frozenset("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Spring Summer Autumn Winter Christmas Easter".split())
_STARTS = frozenset("A According After All Also Although An And Any Are As Ask At Because Before Between Both But By Call Can Concerns Complaints Copy Could Dear Deliver Did Do Does During Each Email Even Every Fax For From Had Has Have He Hello Her Here Hi His Honestly How However I If In Is It Its Just Keep Last Mail Members Minutes Motion My Next No Nobody None Not Of On Once One Only Or Ordinance Our Over People Please Present Put Questions Replies Said Send Several She Should Since So Some Someone Sorry Spending Still Such Tel Text Than Thank Thanks That The Their Then There These They This Those Though To Two Unable Under Until Version Was We Were What When Where Which While Who Whom Why Will With Work Would Yes You Your Home Title Summary Decisions Open Topics Actions Traffic Section Serial Unit Apt Suite Mr Mrs Ms Dr Prof Miss North South East West New Old Saint Mount Fort Great Little Port".split())
_NOT = _ROLES | _THINGS | _WHEN | _STARTS
_CUE_AFTER = re.compile(r"\s*(?:(?:,\s*)?who\b|said\b|says\b|asked\b|asks\b|told\b|disagreed\b|agreed\b|repeat\b|noted\b|added\b|explained\b|reported\b|replied\b|wrote\b|spoke\b|left\b|joined\b|will\b|and the\b|for\b|[:：]\s)")
_CUE_BEFORE = re.compile(r"(?:\b(?:name is|named|called|taken by|written by|guest:|speaker is|hired|thanks to|waited for|according to|before|met|from|with|by|and|attn:?|signed:?|contact:?|chair:?|can|did|is) ?|^[\W\d]*)$", re.I)
_NEXT = re.compile(rf" ([{_UP}][{_LOW}]+)")
_THE = re.compile(r"\b(?:the|a|an|this|Project) $", re.I)
_CUE_PHONE = re.compile(r"(?:\b(?:tel|phone|call|text|fax|voice|mobile|cell|number|dial|ring|line)\b|電話|請打|專線|手機|傳真|撥)[^.。!?]{0,24}$", re.I)
_CUE_ID = re.compile(r"(?:\b(?:id|passport|licen[cs]e|ssn|social security|identity|national insurance|tax|badge|typed|card)\b|身分證|身份證|證號|護照|證件|駕照|統一編號|字號)[^.。!?]{0,28}$", re.I)
_CUE_ID_AFTER = re.compile(r"^\s*(?:as the (?:social|id|passport)|was read out|被唸|into the open)", re.I)
_CUE_NUMBER = re.compile(r"(?:\b(?:serial|invoice|docket|section|ordinance|version|item|order|part|model|lot|case|ticket|page|room|batch|isbn|account ref|ref|code)\b|序號|發票|案號|條例|版本|第)[^.。!?]{0,12}$", re.I)
_SURNAMES = "王李張劉陳楊黃趙吳周徐孫馬朱胡郭何高林羅鄭梁謝宋唐許韓馮鄧曹彭曾蕭田董袁潘于蔣蔡余杜葉程蘇魏呂丁任沈姚盧姜崔鍾譚陸汪范金石廖賈夏韋傅方白鄒孟熊秦邱江尹薛閻段雷侯龍史陶黎賀顧毛郝龔邵萬錢嚴覃武戴莫孔向湯溫康施文牛樊葛邢安齊易喬伍龐顏倪莊聶章魯岳翟殷詹申歐耿關蘭焦俞左柳甘祝包寧尚符舒阮柯紀梅童凌畢單季裴霍涂成苗谷盛曲翁冉駱藍路游辛靳管柴蒙鮑華喻祁蒲房滕屈饒解牟艾尤陽時穆農司卓古吉繆簡車項連蘆麥褚婁竇戚岑景黨宮費卜冷晏席衛米柏宗瞿桂全佟應臧閔苟鄔邊卞姬師和仇欒隋商刁沙榮巫寇桑郎甄叢仲虞敖鞏明佘池查麻苑遲鄺官封談匡鞠惠荊樂冀郁胥南班儲原栗燕楚鄢勞諶奚皮粟冼藺樓盤滿聞位厲伊仝區郜海闞花權強帥屠豆朴蓋練廉禹井祖漆巴豐支卿國狄平計索宣晉相初門雲容敬來扈晁芮都普闕浦戈伏鹿薄邸雍辜羊阿烏母裘亓修邰赫杭況那宿鮮印逯隆茹諾戰慕危玉銀亢嵇公哈湛賓戎勾茅利於呼居揭干但尉冶斯元束檀衣信展陰昝智幸奉植衡富尧閩由"
# Only those of the surnames that seldom begin a word of another kind count without a sign after the name.
# A match is empty and its span is the group: candidates may overlap, decode() chooses.
_NAME_HAN = re.compile(rf"(?=(?<![一-鿿])([{_SURNAMES}][一-鿿]{{1,2}})(?=[:：])|([{_SURNAMES}][一-鿿]{{2}}))")
_NAME_HAN_TWO = re.compile(rf"(?=()([{_SURNAMES}][一-鿿])(?:先生|女士|小姐|老師|博士|教授))")
_HAN_AFTER = re.compile(r"(?:先生|女士|小姐|老師|博士|教授|經理|醫師|律師|議員|說|問|答|表示|認為|進來|離開|補充|發言|提到|同意|反對|寫|念|唸|，|。|、|$|\n|[:：])")
_HAN_BEFORE = re.compile(r"(?:名字是|名叫|我叫|發言的是|紀錄[:：]|記錄[:：]|主席[:：]|出席[:：]|來賓[:：]|列席[:：]|聯絡人[:：]?|請|等到|感謝|謝謝|根據|依據|據|由|和|跟|與|找|雇用了?|聘請了?|聘了|問|是|在|對|^|\n|[。，、：:\]\)] ?)$")
_HAN_STRONG = re.compile(r"(?:名字是|名叫|我叫|發言的是|紀錄[:：]|記錄[:：]|來賓[:：]|等到)$")
_HAN_TITLE = re.compile(r"(?:先生|女士|小姐|老師|博士|教授)")


class Lexicon:
    """What the corpus itself tells: how often a word stands as given name or surname, and a character in a Han given name."""

    def __init__(self, given: dict[str, int] | None = None, family: dict[str, int] | None = None, chars: dict[str, int] | None = None):
        self.given, self.family, self.chars = given or {}, family or {}, chars or {}


#: Times that a word must have been seen in a clear context to count as known.
KNOWN = 3


def _fits(first: str, last: str) -> bool:
    return not {first, last, first.split("-")[0], last.split("-")[0]} & _NOT


# ---------------------------------------------------------------- candidates

Span = tuple[int, int, str, tuple[str, ...]]


def candidates(text: str, lexicon: Lexicon) -> list[Span]:
    """(start, end, type, features) of all spans worth scoring; positions count from 0."""
    out: list[Span] = []
    if "@" in text or "＠" in text or " dot " in text or "at)" in text or "at]" in text or " DOT " in text or " AT " in text:
        for m in _EMAIL.finditer(text):
            sign = "@" in m.group() or "＠" in m.group()
            f = ["email", "email:sign" if sign else "email:words"]
            if re.search(rf"[. )\]]{_TOP}$", m.group(), re.I):
                f.append("email:top")
            out.append((m.start(), m.end(), "email", tuple(f)))
    phones, ids, last = [], [], 0
    for run in _DIGITS.finditer(text):
        if sum(map(run.group().count, "0123456789")) >= 6:
            a, z = max(last, run.start() - 8), run.end() + 16
            whole = lambda found: [m for m in found if m.end() < z or z >= len(text)]  # noqa: B023, E731  # a match at the cut may be the head of a longer one, found from the next run
            phones += whole(_PHONE.finditer(text, a, z))
            ids += whole(_ID.finditer(text, a, z))
            last = run.end()
    phones, ids = ({m.span(): m for m in found}.values() for found in (phones, ids))  # neighbouring runs may both have found one
    for m in phones:
        before = text[max(0, m.start() - 40) : m.start()]
        digits = sum(ch.isdigit() for ch in m.group())
        f = ["phone", "phone:plus" if m.group()[0] == "+" else "phone:bracket" if m.group()[0] == "(" else "phone:groups" if re.search(r"[ .-]", m.group()) else "phone:plain"]
        f += ["phone:cue"] * bool(_CUE_PHONE.search(before)) + ["phone:other_number"] * bool(_CUE_NUMBER.search(before)) + ["phone:id_cue"] * bool(_CUE_ID.search(before))
        f += ["phone:short"] * (digits < 8)
        out.append((m.start(), m.end(), "phone", tuple(f)))
    for m in ids:
        x = m.group()
        before, after = text[max(0, m.start() - 44) : m.start()], text[m.end() : m.end() + 24]
        f = ["id", "id:3-2-4" if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", x) else "id:letters" if x[0].isalpha() else "id:digits"]
        f += ["id:cue"] * bool(_CUE_ID.search(before) or _CUE_ID_AFTER.search(after)) + ["id:other_number"] * bool(_CUE_NUMBER.search(before)) + ["id:phone_cue"] * bool(_CUE_PHONE.search(before) and not _CUE_ID.search(before))
        out.append((m.start(), m.end(), "id_number", tuple(f)))
    low = text.lower()
    plain = text.isascii()
    if sum(map(low.count, _SPOKEN_SIGNS)) >= 5 or not plain and sum(map(text.count, "零〇一二三四五六七八九")) >= 7:
        for m in _SPOKEN.finditer(text):
            before = text[max(0, m.start() - 44) : m.start()]
            kind = "id_number" if _CUE_ID.search(before) and not _CUE_PHONE.search(before) else "phone"
            words = len(re.findall(r"[A-Za-z]+|[零〇一二三四五六七八九]", m.group()))
            f = [f"{kind}:spoken", f"{kind}:spoken_cue" if _CUE_PHONE.search(before) or _CUE_ID.search(before) else f"{kind}:spoken_bare"] + [f"{kind}:spoken_few"] * (words < 7)
            out.append((m.start(), m.end(), kind, tuple(f)))
    for h in _HOUSE.finditer(text):
        if m := _STREET.match(text, h.start()):
            out.append((m.start(), m.end(), "street_address", ("street", "street:number")))
    if any(w in low for w in _SPOKEN_HOUSE):
        out += [(m.start(), m.end(), "street_address", ("street", "street:spoken")) for m in _STREET.finditer(text) if not m.group()[0].isdigit()]
    if "號" in text:
        for m in _STREET_HAN.finditer(text):
            out.append((m.start(), m.end(), "street_address", ("street", "street:han")))
    out += _names(text, lexicon)
    return out


def _names(text: str, lexicon: Lexicon) -> list[Span]:
    out: list[Span] = []
    for start, end, first, last, between, initial, particle in name_forms(text):
        known, family = lexicon.given.get(first, 0) >= KNOWN, lexicon.family.get(last.split("-")[-1], 0) >= KNOWN
        before, after = text[max(0, start - 40) : start], text[end : end + 20]
        f = ["name"] + ["name:given"] * known + ["name:family"] * family + ["name:initial"] * initial + ["name:hyphen"] * ("-" in last) + ["name:particle"] * particle
        f += ["name:honorific"] * bool(_HONORIFIC.search(before)) + ["name:cue_after"] * bool(_CUE_AFTER.match(after)) + ["name:cue_before"] * bool(_CUE_BEFORE.search(before)) + ["name:cue_strong"] * bool(_CLEAR_BEFORE.search(before) and not _HONORIFIC.search(before))
        for w in between:
            f.append("name:between" if lexicon.given.get(w, 0) >= KNOWN or lexicon.family.get(w.split("-")[-1], 0) >= KNOWN else "name:between_unknown")
        nxt = _NEXT.match(after)
        f += ["name:goes_on"] * bool(nxt and nxt.group(1) != "Project" and nxt.group(1) in _ROLES | _THINGS) + ["name:the"] * bool(_THE.search(before))
        out.append((start, end, "name", tuple(f)))
    if lexicon.given:
        for m in _NAME_BACK.finditer(text):
            last, first = m.group(1), m.group(2)
            if _fits(first, last) and lexicon.given.get(first, 0) >= KNOWN and last not in lexicon.given and not _joined(text, m.start()):
                f = ["name", "name:back", "name:given"] + ["name:family"] * (lexicon.family.get(last.split("-")[-1], 0) >= KNOWN)
                out.append((m.start(), m.start(2) + len(first), "name", tuple(f)))
        at = 0
        while m := _NAME_UPPER.search(text, at):
            at = m.start(2)  # the next one may begin with this one's second word
            if lexicon.given.get(m.group(1).title(), 0) >= KNOWN and not _joined(text, m.start()) and m.group(2).split("-")[0].title() not in _NOT:
                f = ["name", "name:upper", "name:given"] + ["name:family"] * (lexicon.family.get(m.group(2).split("-")[-1].title(), 0) >= KNOWN)
                out.append((m.start(), m.end(), "name", tuple(f)))
    if not text.isascii():
        for m in chain(_NAME_HAN.finditer(text), _NAME_HAN_TWO.finditer(text)):
            x = m.group(1) or m.group(2)
            end = m.start() + len(x)
            before, after = text[max(0, m.start() - 5) : m.start()], text[end : end + 3]
            chars = sum(lexicon.chars.get(ch, 0) >= KNOWN for ch in x[1:])
            f = ["name:han"] + ["name:han_chars"] * (chars == len(x) - 1) + ["name:han_label"] * bool(m.group(1)) + ["name:han_two"] * (len(x) == 2)
            f += ["name:han_title"] * bool(_HAN_TITLE.match(after)) + ["name:han_after"] * bool(_HAN_AFTER.match(after)) + ["name:han_before"] * bool(_HAN_BEFORE.search(before)) + ["name:han_strong"] * bool(_HAN_STRONG.search(before))
            out.append((m.start(), end, "name", tuple(f)))
    return out


# ---------------------------------------------------------------- model

def decode(spans: list[Span], weights: dict[str, float], longest: int | None = LONGEST) -> list[Span]:
    """The best set of spans that do not overlap, by dynamic programming over their ends. longest: of a span in characters; None takes all."""
    scored = sorted((s for s in spans if longest is None or s[1] - s[0] <= longest), key=lambda s: (s[1], s[0]))
    if not scored:
        return []
    ends, best, back = [0], [0.0], [(-1, -1)]
    for k, (start, end, _, feats) in enumerate(scored):
        score = sum(weights.get(f, 0.0) for f in feats)
        if score <= 0:
            continue
        i = len(ends) - 1
        while ends[i] > start:
            i -= 1
        if best[i] + score > best[-1]:
            if ends[-1] == end:
                best[-1], back[-1] = best[i] + score, (i, k)
            else:
                ends.append(end)
                best.append(best[i] + score)
                back.append((i, k))
    out, i = [], len(ends) - 1
    while i > 0:
        j, k = back[i]
        out.append(scored[k])
        i = j
    return out[::-1]


# The labelled sample: entities stand in ⟦type:text⟧; slots in braces are filled from the lists below, one after the other.
SENTENCES = (
    "Send the draft to {email} by noon.", "Write {email} if late.", "Reach {name} at {email} today.", "My address is {email}, not the old one.", "We bought 216 units @ $40 for the hall.", "Meet me at noon dot or not.",
    "Ring {phone} or {phone} after six.", "The old line, {phone}, is dead.", "Call {spoken} at night.", "Text {phone} please.", "He can be found under {phone}.", "Fax and voice: {phone}", "The count was {counted}, then we stopped.", "The desk is on {spoken}, ask there.",
    "Lot 5512-210-448 arrived with invoice 555-210-44.", "Serial 4471-430-338 belongs to the lamp.", "The docket is 2025-0613-A and the invoice is 555-613-20.", "Section 810-22-15 and Ordinance 19-5550 were read.", "Item 20412345 and order 0912345678 were sent.", "Version 2.14.208 goes live, see page 415-555-0142.", "Spending reached $637,700, up from $91,300, on 20250613 in all.", "Some 12345678 rows and 987654321 more were read.", "Tram 4412 and 31415926 other things.",
    "Passport {id} was shown to {name}.", "Her social security number is {id}, he said.", "His licence is {id} and her ID {id}.", "Someone typed {id} into the chat.", "The number {ssn} was read out in the hall.", "Identity card: {id}", "Please enter your tax number, {id}, below.", "Her ID is {idwords}, typed twice.", "Phone B2234455 rang, said no one.",
    "They live at {street} now.", "Deliver to {street} on Monday.", "Traffic on Maple Crest Road grew by 12 percent.", "The bridge on Quarry Lane has 40 lamps.", "Bring it to {streetwords} today.",
    "Dr. {name} asked the Budget Officer about it.", "Mr. {name} left.", "Prof. {stranger} wrote the report.", "The Harbor Clerk told {name} that Project Lowell is late.", "{name} said no.", "{name}: I agree with that.", "[0:05] {name}: yes.", "Minutes taken by {name}.", "Minutes taken by {stranger}.", "Thanks to {stranger} and the clerk.", "We waited for {name} and the others.", "We met {name} in May.", "According to {name}, it is late.", "A note from {name} came.", "Please ask {name} or {name} about the lamp.", "The plan was drawn up with {name} last week.", "Guests were {name}, {name} and some others.", "Signed: {back}", "Attending: {back}; {back}.", "We heard {upper} on the tape.", "THEN {upper} LEFT THE ROOM.", "My name is {stranger}, hello.", "The speaker is {stranger}.", "Before {stranger} spoke we had tea.", "As {name} repeat, we go on.", "Was it {name}?", "{name} and the clerk went home.", "The friend of {name} is here.",
    "The {thing} Trust gave 20 trees to the Harbor School.", "{thing} Foundation thanked the Port Lowell Library.", "In May Tenant Planner and Night Clerk met at Lowell Hall.", "The {thing} is a lamp.", "Project {thing} is late.", "This {thing} cost much.", "They sold a {thing} at the fair.", "{thing} sold out in a day.", "It runs on {thing} and on rain.", "We took the {thing} Road to the sea.", "Bring {thing} from the shed.", "With {thing} the work went on.", "By {thing} we mean the old mill.", "{half} Museum is shut.", "The {half} Project went on.", "{half} Road was dug up.", "The clerk of {half} Hall said so.", "Thanks to {half} Library for the books.",
    "請{han}先生說明，電話是{phone}。", "我住在{streethan}。", "他的身分證字號是{id}。", "高架收費表的報價是20萬元，石橋機廠希望3月拿回。", "{hanlabel}：同意。", "會議由{han}主持。", "感謝{han}說明。", "名字是{hanstranger}，請記下。", "紀錄：{han}", "{han}說可以。", "我們等到{hanstranger}進來。", "請找{hantwo}小姐。", "從舊倉庫到高架橋的路程不遠，金額很高。", "方案和計畫都已公布，溫室和水表也是。", "任務完成後高度下降，安全第一。", "請打{phone}找{han}。", "連絡{hanstranger}老師。", "周年活動由專案組長負責，時間未定。", "電話是{spokenhan}。", "任何問題，白天再談。", "聽到{han}，大家都笑。", "她是{han}。",
    "新的訓練教材，下週送到。", "校區恢復，水位也恢復。", "多數人提到山谷專案，少數人提到石門大廳。", "溫度表，金屬殼，都要更換。", "請周末前完成，方向不變。", "老車站，新路線。", "和任務有關的馬路，下月封閉。", "白色的高架橋，黃色的路標。", "江邊平台，林地步道，都開放了。", "費用表、時間表、申請表。", "由安全組說明，與水利組討論。", "問卷結果，向全體公布。",
    "根據溫室的紀錄，冷氣費下降。", "夜班專員，日班專員，都同意。", "谷倉外面，石階旁邊。", "戶外活動：白天。", "主席：方案通過。", "出席：全體專員。", "在車庫裡，有單車。", "對經費表示意見，對水費表示同意。", "古蹟修復說明，雲端資料說明。", "麥田說不上大，米倉說不上小。", "路邊停車，時常客滿，安全堪慮。", "\n農場報告\n金額報告\n水車報告\n", "是文件夾，不是資料夾。", "找舊鑰匙，找新單據。", "莊園大門、花園小門、車道側門。", "平台上，石頭下。", "計畫表：金額。", "方法論，常識題，都考。", "從江口出發，由山口返回。", "時段太短，段落太長，。", "寧靜區，安靜區，水池區。", "左側門、右側門、成人票。", "樂隊來，班車走。", "談經費，談房租，談水電。",
)
_FILL: dict[str, tuple[str, ...]] = {
    "email": ("email", "iris.calder@mail.example", "tom dot okafor at example dot org", "a_b+c@post.example.org", "lea(at)lowell.example", "tess dot quist at mail dot example dot net", "k-m@x1.example.com"),
    "phone": ("phone", "+1 503 555 0148", "(503) 555-0166", "0800 555 0199", "415.555.0142", "16175550142", "+44 7700 900142", "02-5550-0111", "0912-345-678", "(02)5550-0187", "503-555-0177 ext. 12", "020 7946 0142"),
    "spoken": ("phone", "five oh three, five five five, oh one four eight", "two one two, five five five, oh one six five"),
    "id": ("id_number", "C00412345", "912-44-1029", "B122334455", "DL-004412345", "QX 312 554", "951 12 1126", "90211774", "12-3456789", "D1-2233-4455"),
    "ssn": ("id_number", "912-44-1029", "951 12 1126"),
    "idwords": ("id_number", "nine five one, one two, one one two six"),
    "street": ("street_address", "1204 Maple Crest Road, Unit 5, Port Lowell", "88 Saint Orlan St.", "7B Quarry Lane", "41 North Field Avenue, Lowell"),
    "streetwords": ("street_address", "twelve Maple Crest Road", "ninety-one Quarry Lane"),
    "streethan": ("street_address", "海棠市長風路二段18號3樓", "石鏡縣望潮街253號之4", "青田市松徑區白浪大道九號"),
    "name": ("name", "Iris Calder", "Tomas Okafor", "Iris B. Calder", "Anna Voss-Calder", "Anna Iris Okafor", "Tomas van Calder", "Iris Quist", "Anna Calder"),
    "stranger": ("name", "Odra Calder", "Belan Quint", "Sef T. Marwick", "Rolf de Wendt"),
    "back": ("name", "Calder, Iris", "Okafor, Anna", "Quist, Tomas"),
    "upper": ("name", "IRIS CALDER", "ANNA OKAFOR", "TOMAS QUIST"),
    "han": ("name", "沈書瑜", "王書瑜", "林瑜書", "謝書瑜"),
    "hanlabel": ("name", "沈書瑜", "王瑜"),
    "hanstranger": ("name", "陳冠宏", "李佩芬"),
    "hantwo": ("name", "王瑜", "林書"),
    "spokenhan": ("phone", "零二五五五零零一八七",),
    "thing": ("", "Silver Lantern", "Maple Crest", "Blue Kestrel", "Open Harvest", "Quiet Kiln"),
    "half": ("", "Iris Calder", "Tomas Lowell", "Anna Crest"),
    "counted": ("", "one, two, three, four, five, six"),
}
#: Most sentences that the model is fitted on: every sentence is filled in until its longest list is used up.
SAMPLE = 400


def labelled(most: int = SAMPLE) -> list[str]:
    """The sample, slots filled."""
    out = []
    for n, sentence in enumerate(SENTENCES):
        slots = re.findall(r"\{(\w+)\}", sentence)
        for k in range(max([1, *(len(_FILL[x]) - 1 for x in slots)])):
            line = sentence
            for j, x in enumerate(slots):
                kind, *values = _FILL[x]
                value = values[(k + j + n) % len(values)]
                line = line.replace("{" + x + "}", f"⟦{kind}:{value}⟧" if kind else value, 1)
            out.append(line)
    return out[:: max(1, -(-len(out) // most))]


LABELLED = tuple(labelled())
#: What the corpus is taken to know while the model is fitted.
SAMPLE_LEXICON = Lexicon({"Iris": 9, "Tomas": 9, "Anna": 9}, {"Calder": 9, "Okafor": 9}, {"書": 9, "瑜": 9})


def parse_labelled(line: str) -> tuple[str, set[tuple[int, str]]]:
    text, gold, at = "", set(), 0
    for m in re.finditer(r"⟦(\w+):([^⟧]+)⟧", line):
        text += line[at : m.start()]
        gold.add((len(text), m.group(1)))
        text += m.group(2)
        at = m.end()
    return text + line[at:], gold


def marginals(spans: list[Span], weights: dict[str, float]) -> tuple[list[float], float]:
    """Probability of each span under the model, and the logarithm of its normaliser: sums over all sets of spans that do not overlap, by a forward and a backward pass."""
    places = sorted({0, *(x for s in spans for x in s[:2])})
    at = {x: i for i, x in enumerate(places)}
    score = [exp(sum(weights.get(f, 0.0) for f in s[3])) for s in spans]
    forward, backward = [1.0] * len(places), [1.0] * len(places)
    by_end, by_start = defaultdict(list), defaultdict(list)
    for k, s in enumerate(spans):
        by_end[at[s[1]]].append(k)
        by_start[at[s[0]]].append(k)
    for i in range(1, len(places)):
        forward[i] = forward[i - 1] + sum(score[k] * forward[at[spans[k][0]]] for k in by_end[i])
    for i in range(len(places) - 2, -1, -1):
        backward[i] = backward[i + 1] + sum(score[k] * backward[at[spans[k][1]]] for k in by_start[i])
    z = forward[-1]
    return [score[k] * forward[at[s[0]]] * backward[at[s[1]]] / z for k, s in enumerate(spans)], log(z)


#: Steps and rate of the ascent, and the standard deviation of a weight about zero.
STEPS, RATE, SPREAD = 400, 1.0, 3.0


def aligned(line: str, lexicon: Lexicon) -> tuple[list[Span], list[bool]]:
    """The lattice of a labelled sentence, and which of its spans are entities, both ends and type right."""
    text, gold = "", set()
    at = 0
    for m in re.finditer(r"⟦(\w+):([^⟧]+)⟧", line):
        text += line[at : m.start()]
        gold.add((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        at = m.end()
    spans = candidates(text + line[at:], lexicon)
    return spans, [s[:3] in gold for s in spans]


@cache
def fitted() -> dict[str, float]:
    """Weights that maximise the likelihood of LABELLED under a Gaussian prior about zero: ascent with a step of its own for each weight. Fitted once, by the driver; workers get the weights."""
    data = [aligned(line, SAMPLE_LEXICON) for line in LABELLED]
    weights: dict[str, float] = defaultdict(float)
    size: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(STEPS):
        slope: dict[str, float] = defaultdict(float)
        for f, w in weights.items():
            slope[f] = -w / SPREAD**2
        for spans, gold in data:
            for s, true, p in zip(spans, gold, marginals(spans, weights)[0]):
                for f in s[3]:
                    slope[f] += true - p
        for f, x in slope.items():
            size[f] += x * x
            weights[f] += RATE * x / size[f] ** 0.5
    return dict(weights)


def entities(text: str | None, lexicon: Lexicon, weights: dict[str, float] | None = None) -> list[Span]:
    return decode(candidates(text, lexicon), weights or fitted(), None) if text else []


def masked(text: str | None, found: list[Span]) -> str | None:
    """The text with each entity replaced by the mark of its type; everything else stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind, _ in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- lexicon of the corpus

_CLEAR_BEFORE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\. |\b(?:name is|taken by|Thanks to|hired|waited for|According to|before|guest:|speaker is|Can|signed) )$")
_CLEAR_AFTER = re.compile(r" (?:said|asked|disagreed|told|noted|repeat|and the clerk)\b")
_CLEAR_HAN = re.compile(rf"(?:名字是|名叫|發言的是|紀錄：|等到|請)([{_SURNAMES}])([一-鿿]{{2}})(?=先生|女士|小姐|老師|博士|進來|。|，|$|\n)|([{_SURNAMES}])([一-鿿]{{2}})(?=先生|女士|小姐)")


def _clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for b in batches:
        for text in b["text"]:
            if not text:
                continue
            for start, end, first, last, between, _, _ in name_forms(text):
                label = text[end : end + 1] in (":", "：") and (start == 0 or text[start - 1] == "\n" or text[max(0, start - 2) : start] in ("] ", "- "))
                # Of two signs the one on the longer side must be there where more than two words stand together.
                if label or _CLEAR_AFTER.match(text, end) and not between or _CLEAR_BEFORE.search(text[max(0, start - 16) : start]) and not between and not _NEXT.match(text, end):
                    seen["given", first] += 1
                    for part in last.split("-"):
                        seen["family", part] += 1
                    for w in between:
                        seen["given", w] += 1
            if not text.isascii():
                for m in _CLEAR_HAN.finditer(text):
                    for ch in m.group(2) or m.group(4):
                        seen["chars", ch] += 1
        if len(seen) > 500_000:
            yield pd.DataFrame([(k, w, n) for (k, w), n in seen.items()], columns=["kind", "word", "n"])
            seen.clear()
    yield pd.DataFrame([(k, w, n) for (k, w), n in seen.items()], columns=["kind", "word", "n"])


def learn_lexicon(documents: DataFrame, text: str = "text") -> tuple[Lexicon, DataFrame | None]:
    """Counted over all documents: what the driver holds, and (kind, word) of all known names where they are more than LEXICON.

    Characters of Han names always come to the driver: there are 20,992 at most.
    """
    counts = documents.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(_clear, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= KNOWN)
    counts = durable(counts, "lexicon")
    names = counts.filter("kind <> 'chars'")
    many = names.limit(LEXICON + 1).count() > LEXICON
    found: dict[str, dict[str, int]] = {"given": {}, "family": {}, "chars": {}}
    for r in (counts.filter("kind = 'chars'") if many else counts).toLocalIterator():
        found[r["kind"]][r["word"]] = r["n"]
    return Lexicon(**found), names.select("kind", "word") if many else None


class _Asked(dict):
    """Says that it knows every word, and keeps those it was asked for."""

    def __init__(self) -> None:
        self.words: set[str] = set()

    def __bool__(self) -> bool:
        return True

    def __contains__(self, word: object) -> bool:
        self.words.add(str(word))
        return False

    def get(self, word: str, default: int = 0) -> int:
        self.words.add(word)
        return KNOWN


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, kind, word) of all words of the batches (key, text) that candidates() looks up."""
    for b in batches:
        out = []
        for key, text in zip(b["key"], b["text"]):
            given, family = _Asked(), _Asked()
            _names(text, Lexicon(given, family))
            out += [(key, kind, w) for kind, asked in (("given", given), ("family", family)) for w in asked.words]
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "word"])


def with_names(documents: DataFrame, names: DataFrame | None) -> DataFrame:
    """documents with given and family, the known names among the words of their texts, by joins on the word; both null where the driver's lexicon holds all."""
    if names is None:
        return documents.withColumns({c: F.lit(None).cast("array<string>") for c in ("given", "family")})
    keyed = documents.withColumn("key", F.md5("text"))
    asked = keyed.filter("text is not null").select("key", "text").mapInPandas(_asked, "key string, kind string, word string").distinct()
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("word"))).alias(kind)
    known = asked.join(names, ["kind", "word"]).groupBy("key").agg(of("given"), of("family"))
    return keyed.join(known, "key", "left").drop("key")


def lexicons(b: pd.DataFrame, whole: Lexicon) -> Iterator[Lexicon]:
    """The lexicon for each row of with_names()."""
    for given, family in zip(b["given"], b["family"]):
        yield whole if given is None else Lexicon(dict.fromkeys(given, KNOWN), dict.fromkeys(family, KNOWN), whole.chars)


# ---------------------------------------------------------------- operators


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos): one row per entity; positions count code points from 1.

    Null and empty texts have none; rows without doc_id are left out; a document that
    is stored twice under one id gives its rows once. Texts are read whole.
    """
    weights = fitted()
    whole, names = learn_lexicon(documents)
    lexicon = documents.sparkSession.sparkContext.broadcast(whole)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, kind, start + 1) for i, t, lex in zip(b["doc_id"], b["text"], lexicons(b, lexicon.value)) for start, _, kind, _ in entities(t, lex, weights)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos"])

    rows = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    return with_names(rows, names).mapInPandas(kernel, "doc_id long, pii_type string, start_pos int").distinct()


def mask_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, entities, text): every row, its text with entities replaced by [TYPE]; null texts stay null."""
    weights = fitted()
    whole, names = learn_lexicon(documents)
    lexicon = documents.sparkSession.sparkContext.broadcast(whole)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [entities(t, lex, weights) for t, lex in zip(b["text"], lexicons(b, lexicon.value))]
            yield pd.DataFrame({"doc_id": b["doc_id"], "entities": [len(x) for x in found], "text": [masked(t, x) for t, x in zip(b["text"], found)]})

    return with_names(documents.select(F.col("doc_id").cast("long"), "text"), names).mapInPandas(kernel, "doc_id long, entities int, text string")
