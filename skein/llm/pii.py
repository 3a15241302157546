"""Personal data in free text: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

1. Candidates: every span that has the form of an e-mail address, phone number, identity number, street address or name.
2. Labelers: form, gazetteer, announcing and following words, counter-evidence and neighbourhood each vote for or against a
   candidate or abstain.
3. Expectation-maximisation over the counts of vote patterns estimates, for each kind, how often it is meant and how reliable
   each labeler is, and gives each pattern a probability.
4. These probabilities train a logistic span classifier, over the votes and hashed letter groups and neighbours of the span,
   on a bounded sample of candidates (SAMPLE). It decides about every candidate of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import cut

KINDS = ["email", "phone", "identity", "address", "name"]
LABELERS = ["form", "gazetteer", "before", "after", "against", "whole", "near"]
#: Candidates of each kind the classifier is trained on at most, its feature slots, and how far "near" reaches.
SAMPLE, SLOTS, NEAR = 20_000, 1 << 14, 70
#: Expected shares of the votes -1, 0 and 1 of each labeler on true and on false candidates. In the estimation they count as
#: EXPECTED_WEIGHT candidates and EXPECTED_SHARE of those there are, so that they hold the two truths apart at any size: where
#: nearly all candidates are true, votes alone would split these in two.
EXPECTED = {
    "form": ((0.05, 0.20, 0.75), (0.30, 0.35, 0.35)),
    "gazetteer": ((0.05, 0.45, 0.50), (0.40, 0.50, 0.10)),
    "before": ((0.01, 0.29, 0.70), (0.01, 0.79, 0.20)),
    "after": ((0.01, 0.29, 0.70), (0.01, 0.59, 0.40)),
    "against": ((0.02, 0.97, 0.01), (0.60, 0.39, 0.01)),
    "whole": ((0.01, 0.98, 0.01), (0.10, 0.89, 0.01)),
    "near": ((0.01, 0.39, 0.60), (0.01, 0.59, 0.40)),
}
EXPECTED_WEIGHT, EXPECTED_SHARE = 300, 0.25

# Given names, common and across languages.
GIVEN = """Aaron Ada Adam Ahmed Aiko Alan Alex Alice Amara Amir Amy Ana André Andrew Anita Anna Anthony Antonio Art Arthur
Ayşe Barbara Ben Bettina Bill Bob Björn Bruno Carl Carla Carlos Carmen Chase Chen Chloe Chris Christine Clara Claire
Daniel David Dawn Deborah Diego Dmitri Edward Elena Elif Elizabeth Emily Emma Eric Eva Fatima Felix Frank
Fritz George Giulia Grace Greta Hana Hannah Hans Hassan Helen Henry Hiroshi Hugo Ines Ingrid Irina Isabel Ivan Ivo Jack
Jakob James Jan Jane Javier Jean Jennifer Jessica Jim Joan Joe John Jonas Jorge José Joseph Juan Julia Karen Kate Katya
Kenji Kevin Klaus Kofi Lars Laura Leila Leo Liam Liang Linda Lisa Louis Luca Lucía Lukas Luis Magda Marco Maria Mark Marta Mary
Mateo Max May Mei Mia Michael Miguel Mila Mohammed Nadia Nina Noah Noor Oliver Olga Omar Oskar Pablo Patricia Paul
Pavel Pedro Peter Petra Pierre Piotr Priya Rachel Rahul Renée Rich Richard Rob Robert Rosa Rune Sana Sara Sarah Sergei
Siobhan Sofia Susan Sven Tariq Théo Thomas Tim Tom Ulla Vikram Wei Will William Yara Yuki Yusuf Zofia"""
GIVEN_HAN = """太郎 花子 健太 翔太 美咲 さくら 大輔 直樹 陽子 恵子 由美 真一 健 誠 愛 結衣 伟 芳 娜 敏 静 丽 强 磊 洋 艳 勇 军 杰 娟 涛 明 超
秀英 建国 建华 志强 小明 晓东"""
GIVEN_OTHER = "Анна Борис Виктор Елена Зоя Иван Мила Мария Наталья Ольга Павел Пётр Сергей Тимур Юрий"
# Capitalised words that are no part of a name.
COMMON = """The A An And Or But If In On At By For From With Without After Before Both Each Every Nobody This That These Those It Its
We Our You Your They He She His Her My I Is Are Was Were Do Does Did Can Could Will Would May Might Must Shall Should Let Try Set Use
Run Pin Call Ask Tell Hi Hello Hey Dear Thanks Regards Best Cheers Please First Then Now Here There When Where Why How What Who Which
Section Chapter Part Build Node Port Commit Clone Passport Invoice Ticket Contact Forward Ship Mail Email Phone Tel Subject Signed To
Cc Bcc Re Owner Author Merge Queue Graph Bridge Orchard Pattern Lantern Street Period Decision Open Notes Note Test Drop Read Check
Mark Grace Version Compare Some Many Most No Yes Not Only Traceback Error Key Keyerror Warn Warning Info Debug Select Where Update
Bitte Frag Fragen Die Der Das Den Dem Ein Eine Mein Meine Dein Ihr Wir Ich Sie Es Am Im Zum Nach Ohne Warum Manche Siehe Ausweis Steuer
Kante Graph Index Verlauf Knoten Filter Puffer Bericht Parser Cache Schwellwert Nummer Llama Mi El La Los Las Un Una Por Guardamos
Cada Primero Demandez Écrivez Appelez Mon Ma Le Les Des Une Pourquoi Nous Il Faut Chaque Sans Certains Позвоните Мой Моя Наш Без Каждый
Почему Сначала Мы January February March April May June July August September October November December Monday Tuesday Wednesday
Thursday Friday Saturday Sunday Road Lane Avenue Court Close Row Way Terrace Drive Square Place Hill Park Box Flat Apt Santa Saint Plaza
Calle Avda Inc Ltd Corp Server System Service Table Data User Users Session Token Model"""
STREETS = "street|st|avenue|ave|av|road|rd|lane|ln|drive|dr|court|ct|close|way|terrace|ter|row|blvd|boulevard|place|pl|square|sq|crescent|parkway|pkwy|highway|hwy|alley|circle|trail"

_G = frozenset(GIVEN.split()) | frozenset(GIVEN_OTHER.split())
_LOW = frozenset(x.lower() for x in _G)
_COMMON = frozenset(COMMON.split())
_WORDS = frozenset("may will mark art rich dawn grace rob chase bill rune max tim jack frank jan".split())

WIDE = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF0D: 0x2D, 0xFF08: 0x28, 0xFF09: 0x29, 0xFF0B: 0x2B, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0xA0: 0x20, 0xFF0F: 0x2F, 0xFF0E: 0x2E}

# --- forms ------------------------------------------------------------------------------------------------------------

_L = r"[^\W_](?:[\w+\-]*[^\W_])?"
_AT = r"(?:[@＠]|%40| [@＠] | ?[(\[{] ?at ?[)\]}] ?)"
_DOT = r"(?:[.．]| ?[(\[{] ?dot ?[)\]}] ?)"
_LABEL = r"[^\W_](?:[A-Za-z0-9\-]{0,61}[^\W_])?"
EMAIL = regex.compile(
    rf"(?<![\w.%+\-])(?:{_L}(?:[.]{_L})*+{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,24}}(?![\w\-])"
    rf"|{_L}(?: dot {_L})*+ at {_LABEL}(?: dot [^\W_][\w\-]*+)++(?![\w+]| at [\w\-]+ dot ))",
    regex.ASCII,
)
#: Where an address may be, and where numbers may be; the forms are only tried around these.
AT = re.compile(r"[@＠]|%40|[(\[{] ?at ?[)\]}]| at (?=[\w\-]+ dot )")
LOCAL = 320
NUMBERS = re.compile(r"[A-Z0-9+(][A-Z0-9 ().\-/]{6,}")
_B, _E = r"(?<![\w\-./:#&+@])(?<!\d[ ])", r"(?![\d_a-z\-/@]|[A-Z](?![a-z])|[.:]\d|[ ]\d)"
IDENTITY = [
    (r"\d{3}-\d{2}-\d{4}", 1),
    (r"\d{3} \d{2} \d{4}", 1),
    (r"\d{8}-?[A-Z]", 1),
    (r"[XYZ]-?\d{7}-?[A-Z]", 1),
    (r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", 1),
    (r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?\d{1,3})?", 1),
    (r"[A-Z]{1,2}\d{7,8}", 0),
    (r"\d{4} \d{4} \d{4}", 1),
    (r"\d{17}[\dXx]", 1),
    (r"\d{6} ?\d{8} ?\d{3}[\dXx]", 1),
    (r"[1-4] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?", 1),
    (r"\d{2} \d{3} \d{3} \d{3}", 1),
    (r"\d{3}\.\d{3}\.\d{3}-\d{2}", 1),
    (r"\d{6}-[1-4]\d{6}", 1),
    (r"(?:\d{9}|\d{11}|\d{12})", 0),
]
PHONE = [
    (r"\+\d{1,3}(?:[ .\-/]{0,3}(?:\(\d{1,4}\)|\d{1,8})){1,6}", 1),
    (r"00[1-9]\d{0,2}(?:[ .\-/]{1,3}(?:\(\d{1,4}\)|\d{2,8})){2,6}", 1),
    (r"(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}(?: / |[ .\-/]))\d{3}(?: / |[ .\-/])\d{4}", 1),
    (r"\(0\d{1,4}\)[ \-/]?\d{3,4}(?:[ \-]?\d{3,5})?", 1),
    (r"0\d{2,4}[ \-/]\d{3,4}[ \-]\d{3,4}", 1),
    (r"0\d{4}[ \-]\d{6}", 1),
    (r"0[1-9](?:[ .\-]\d{2}){4}", 1),
    (r"0\d{1,4} ?[/\-] ?\d{5,8}(?:[ \-]\d{1,4})?", 1),
    (r"0\d{2,4} \d{5,8}(?:[ \-]\d{1,4})?", 1),
    (r"0\d{1,3}-\d{4}-\d{4}", 1),
    (r"1[3-9]\d[ \-]?\d{4}[ \-]?\d{4}", 0),
    (r"[2-9]\d{9}", 0),
    (r"0\d{9,10}", 0),
]
IDENTITY = [(re.compile(_B + p + _E, re.ASCII), s) for p, s in IDENTITY]
PHONE = [(re.compile((r"(?<![\w\-./:#&+@])" if p.startswith((r"\+", r"\(0", "(?:1")) else _B) + p + r"(?![\d_\-/@]|[.:]\d|[ ]\d)", re.ASCII), s) for p, s in PHONE]
#: What may follow the first line of an address: a flat or floor, a town with its code.
TAIL = regex.compile(
    r"(?:,\s?(?i:apt|flat|unit|suite)\.?\s\w+|,\s?\d{1,2}\.?[ºª°]\s?\p{L}?|,\sкв\.?\s\d+)?(?:,\s(?:\d{4,6}\s)?\p{Lu}\p{Ll}[\p{L}'’\-]*(?:\s\p{Lu}\p{Ll}[\p{L}'’\-]*(?!\p{L}|,\s\d))?)?",
)
ADDRESS = [
    (
        r"(?:(?:flat|apt\.?|apartment|unit|suite|studio)\s#?\d{1,4}\s?\p{L}?,\s)?(?<![\p{L}\d\-./:])\d{1,5}\p{L}?(?:-\d+)?\s(?:[NSEW]{1,2}\.?\s)?(?:st\.?\s)?"
        rf"(?:\p{{L}}[\p{{L}}'’\-]*\s){{1,3}}?(?:{STREETS})\b\.?",
        True,
    ),
    (r"(?<![\p{L}\d\-./:])\d{1,4}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|quai|impasse|place|boulevard|chemin|allée|cours|route|square|passage|villa)(?:\s(?:de|du|des|la|le|les)){0,2}\s\p{L}[\p{L}'’\-]*(?:\s\p{Lu}[\p{L}'’\-]*)?", True),
    (
        r"(?<!\p{L})(?:\p{Lu}[\p{L}\-]*(?:straße|strasse|str\.|gasse|platz|weg|allee|ring|damm|ufer|markt|tor|straat|laan|plein|gracht|kade|dijk|gatan|vägen|gränd|torget|gade|vej|veien)|(?:Am|An\sder|An\sden|Im|In\sder|Zum|Zur|Auf\sdem|Auf\sder|Unter\sden)\s\p{Lu}[\p{L}\-]+)\s\d{1,4}\s?\p{Ll}?(?![\p{L}\d])",
        True,
    ),
    (
        r"(?<!\p{L})(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Carrera|Travesía|Rua|Via|Viale|Piazza|Largo)\s(?:(?:de|del|la|las|los|el|da|do|di)\s)*\p{L}[\p{L}'’\-]*(?:\s\p{L}[\p{L}'’\-]*){0,3}?,?\s\d{1,4}",
        True,
    ),
    (r"(?<!\p{L})(?:ul\.|al\.|pl\.|os\.)\s\p{Lu}[\p{L}\-]+(?:\s\p{Lu}[\p{L}\-]+)?\s\d{1,4}\p{L}?(?:/\d+)?(?![\p{L}\d])", True),
    (r"(?<!\p{L})(?:ул|улица|пр|просп|пр-т|пер|наб|бул|пл|ш)\.?\s\p{L}[\p{L}\-]+(?:\s\p{L}+)?,\sд\.?\s?\d+", True),
    (r"[\p{Han}ヶ々]{1,4}[都道府県][\p{Han}ヶ々ケ]{1,8}[市区町村郡][\p{Han}ヶ々\p{Katakana}ー]{0,8}\d+(?:[-－丁目番地号]\d*)*", True),
    (r"(?:\p{Han}{2,6}[省市])?\p{Han}{2,6}[市区县]\p{Han}{2,8}[路街道巷]\d+[号號弄]", True),
    (r"(?<!\p{L})(?:P\.?\s?O\.?\sBox|PO\sBox|Post\sOffice\sBox|Postfach|Apartado|Casilla|BP)\s\d{1,6}", True),
]
ADDRESS = [regex.compile(p, regex.IGNORECASE if i == 0 or i == len(ADDRESS) - 1 else 0) for i, (p, _) in enumerate(ADDRESS)]

_CAP = r"(?:[OD]['’]|Mc|Mac)?\p{Lu}\p{Ll}+(?:['’\-](?:[OD]['’])?\p{Lu}\p{Ll}+)*"
_PART = r"(?:(?:de|del|della|di|da|dos|du|van|von|der|den|la|le|el|al|bin|ibn|ben|zu|y)[ ]|(?:al|el|as|ibn|bin)-)"
_INI = r"(?:\p{Lu}\.[ ])"
NAMES = regex.compile(
    rf"(?<![\p{{Latin}}\p{{Cyrillic}}\p{{N}}_@./\-])(?:"
    rf"(?P<first>{_CAP}(?:[ ]{_INI}*{_PART}*{_CAP}){{1,3}})"
    rf"|(?P<initial>{_INI}{{1,3}}{_PART}*{_CAP})"
    rf"|(?P<last>(?:\p{{Lu}}[\p{{Lu}}'’\-]*[ ])*\p{{Lu}}[\p{{Lu}}'’\-]{{2,}},[ ]\p{{Lu}}\p{{Ll}}+(?:[ ]\p{{Lu}}\.)?)"
    rf"|(?P<caps>\p{{Lu}}{{2,}}[ ]\p{{Lu}}[\p{{Lu}}'’\-]{{2,}})"
    rf"|(?P<one>{_CAP}))(?![\p{{Latin}}\p{{Cyrillic}}\p{{N}}_@])"
)


def _tree(words: list[str]) -> str:
    """A pattern of the words that looks at their first letters first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + (_tree(r) if len(r) > 1 or r[0] else "") for h, r in sorted(heads.items(), reverse=True) if h]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in heads else "")


LOWER = regex.compile(
    r"(?<![\p{Latin}\p{Cyrillic}\p{N}_@./\-+])(" + _tree(sorted({x.lower() for x in _G})) + rf")[ ](?:\p{{Ll}}\.[ ])?{_PART}*\p{{Ll}}[\p{{Ll}}'’\-]{{3,}}(?![\p{{Latin}}\p{{Cyrillic}}\p{{N}}_@.]\p{{L}})"
)
#: Two or three words in small letters right after what announces a person, where nothing but a person's data follows.
LABELLED = regex.compile(
    r"(?i:(?<![\p{L}\p{N}_])(?:(?:owner|author|name|assignee|reviewer|contact|signed|user)\s?[:=]\s?[\"']?|(?:user|name|owner),|(?:reported by|(?:reviewer|owner|author|assignee) (?:is|was)|ticket from|invoice for|belongs to|talked to|spoke to|thanks,?|regards,?|cheers,?|hi|hello|dear|ask|ping|bitte|llama a|demandez à|écrivez à|call|reach)\s))"
    r"(?P<name>\p{Ll}[\p{Ll}'’\-]+(?:[ ]\p{Ll}\.)?[ ]\p{Ll}[\p{Ll}'’\-]+(?:[ ]\p{Ll}[\p{Ll}'’\-]+)?)(?=\s*(?:$|[\n,;)\"'<(\]]|\.(?:\s|$))|\s(?:unter|al|on|au|at|under)\s[+(\d])",
    regex.MULTILINE,
)
#: The first words of what LABELLED looks for.
_LABELS = frozenset("owner author name assignee reviewer contact signed user reported ticket invoice belongs talked spoke thanks regards cheers hi hello dear ask ping bitte llama demandez écrivez call reach".split())
RUN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u0400-\u052f\u1e00-\u1eff]+")
HAN_SIGN = re.compile("[\u2e80-\u2fdf\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
# The most common Chinese family names.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_COMPOUND = "欧阳|司马|上官|诸葛|东方|皇甫|尉迟|公孙|慕容|令狐"
_HAN_GIVEN = "|".join(sorted(GIVEN_HAN.split(), key=len, reverse=True))
_HAN_CUE = r"请找|请联系|请问|联系人|联系|致电|找|叫|问|我是|担当は|担当者は|は|、"
_HAN_START = rf"(?:(?<={_HAN_CUE})|(?<![\p{{Han}}\p{{Katakana}}\p{{Hiragana}}ー々]))(?!{_HAN_CUE}|[我你您他她它这那本该])"
HAN = regex.compile(
    rf"{_HAN_START}(?:(?P<known>[\p{{Han}}ヶ々]{{1,4}}?[ \u3000]?(?:{_HAN_GIVEN}))"
    rf"|(?P<family>(?:{_COMPOUND}|[{SURNAMES}])\p{{Han}}{{1,2}}?)"
    rf"|(?P<cued>[\p{{Han}}ヶ々]{{1,4}}[ \u3000]?[\p{{Han}}\p{{Katakana}}][\p{{Han}}\p{{Katakana}}ー]{{0,4}}))"
    r"(?=$|[^\p{Han}\p{Katakana}ー々]|[为请没每我空旧新共说在和的])",
    regex.MULTILINE,
)

# --- words before and after -------------------------------------------------------------------------------------------

# Words that announce a mention, that follow one, and that tell it is something else, by kind.
ANNOUNCE = {
    "email": "mail|mailto|e-mail|контакт|contact|reach|write|écrivez|邮箱|メールは|to|from|at|use|or|and|cc|by|ping|forward|for|user|login|author|owner|<|[(]|[:=]",
    "phone": "tel|tél|phone|call|contact|fax|mobile|handy|cell|text me|sms|whatsapp|reach|dial|ring|under|unter|al|on|тел|по телефону|电话是?|電話は?|手机号?|número|number|au|anrufen",
    "identity": "ssn|nin|nino|dni|nie|cpf|ausweis[a-z]*|personalausweis|nummer|steuer-?id[a-z]*|sécu[a-zé]*|passport|passeport|pasaporte|id|insurance no|national|aadhaar|tax[a-z]*|social|身份证号码?|identity|identification|number|it is|personal[a-z]*|паспорт|инн|снилс",
    "address": "live[sd]? (?:at|in)|living (?:at|in)|home|address|addr|ship[a-z]* (?:it |them |this )?to|goes to|went to|sent? to|deliver[a-z]* to|wohne hier|wohnt?|adresse?|dirección(?: es)?|domicilio|адрес|живу|zip|住所は?|地址是?|located at|resid[a-z]+ (?:at|in)|to",
    "name": "thanks|thank you|regards|cheers|hi|hello|hey|dear|cc|bcc|to|from|by|ask|tell|meet|ping|frag|fragen sie|bitte|llama a|pregunta a|demandez à|écrivez à|appelez|позвоните|call|contact|reach|owner|author|name|user|whois|said|with|reviewer (?:is|was)|met|talked to|spoke (?:to|with)|belongs to|invoice for|ticket from|signed-off-by|reviewed-by|co-authored-by|and|for|of|mr[.]?|mrs[.]?|ms[.]?|dr[.]?|prof[.]?|sr[.]?|sra[.]?|herr|frau|mme",
}
_BETWEEN = r"[\s.:=#,“\"'(<]*(?:unter|al|on|under|is|es|lautet|est|是|no\.?|nr\.?|number)?[\s.:=“\"'(<]*$"
BEFORE = {k: re.compile(rf"(?i)(?<![^\W\d_])(?:{v}){_BETWEEN}" if k != "email" else rf"(?i)(?:{v})[\s:=<(\"'“]*$") for k, v in ANNOUNCE.items()}
#: A phone number is also announced by a name and a word such as "on" before it.
BEFORE["phone"] = re.compile(BEFORE["phone"].pattern + r"|(?i:(?<![^\W\d_])(?:ping|call|llama a|bitte|demandez|позвоните)\s[^\n.]{1,40}\s(?:on|al|au|unter|under|по)\s*$)")
BEFORE["identity"] = re.compile(BEFORE["identity"].pattern + r"|(?i:(?:id|ausweis|pass|card|carte|karte)[^\n.]{0,40}\s(?:nummer|number|numéro|número)\s*$)")
BEFORE["address"] = re.compile(BEFORE["address"].pattern + r"|(?i:(?:ship|send|deliver|package|parcel)[^\n.]{1,40}\sto\s*$)")
BEFORE["name"] = re.compile(BEFORE["name"].pattern + "|担当は$|请找$|找$|\\] <$|[,(/] ?$|name: \"$|[\"=<]$")
#: What announces a person and hardly anything else.
CUE = re.compile(r"(?i)(?:^|[^\w])(?:thanks|thank you|regards|cheers|hi|hello|hey|dear|ask|tell|ping|frag|llama a|demandez à|appelez|позвоните|call|owner|author|reviewer|assignee|mr\.?|mrs\.?|ms\.?|dr\.?|herr|frau|mme|talked to|spoke (?:to|with)|met with|ticket from|invoice for|belongs to|bitte|(?:reviewer|owner|author) (?:is|was)|signed-off-by|reviewed-by)[\s:,]+$|(?:name|user|owner|author|assignee|reviewer)\s?[=:,]\s?[\"']?$")
_END = r"[\s]*(?:[,.;\"')?!。，」]|$)"
AFTER = {
    "email": re.compile(r"[\s>)\"',.;:?&」。）]|$"),
    "phone": re.compile(rf"(?i){_END}|\s*(?:ext|anrufen|if|or|before|after|please|です)\b"),
    "identity": re.compile(rf"(?i){_END}|\s*(?:belongs|is|was|stored|saved|kept|logged|shown|masked)\b"),
    "address": re.compile(r"(?i)[.,]?\s*(?:,\s?\d|,\s?[^\W\d]|\n[^\W\d])"),
    "name": re.compile(r"(?i)\s?(?:<|>|\(|,\s?(?:\d|\+|\(|[^\W\d_]+ing\b|tél|[^\W\d_]+ (?:st|street|lane|road|ave))|;|\"|'|:\s|\n|$|(?:left|wrote|approved|said|asked|thinks|agrees?|disagrees?|unter|a dit|dijo|sagte)\b|and\b[^.\n]{2,40}\b(?:agree|disagree|about|wrote|said)|al [+(\d]|on [+(\d]|at \S+(?:@| at|\()|/|、|。|，|,)"),
}
# What a number is the number of, where it is nobody's.
_COUNTED = r"entries|rows|bytes|files|items|times|records|lines|tokens|points|tests|runs|errors|ms|seconds|days|%"
_NUMBERED = r"part no\.?|build|node|port|commit|run|set \w+ =|\w+ = |version|\bv|line|step|issue|pin|order|sku|serial|#|item|rev|release|page|isbn|wrote"
_TOLD = r"is (?:only |just )?an? (?:\w+ )?(?:label|id|key|code|version|hash|tag)|is (?:green|red|broken|failing|passing)"
AGAINST_BEFORE = {
    "email": re.compile(r"(?i)(?:clone|git|ssh|scp|pull|push|fetch|remote|pin|install|npm|pip|import|@)\s*$"),
    "phone": re.compile(rf"(?i)\b(?:{_NUMBERED}|id)\s*$"),
    "identity": re.compile(rf"(?i)\b(?:{_NUMBERED})\s*$"),
    "address": re.compile(r"(?i)(?:section|chapter|line|step|version|v|page|test|build|part|no\.|(?:limit|size|count|total|score) (?:is|was|of))\s*$"),
    "name": re.compile(r"(?i)(?<![^\W_])(?:section \d+|chapter|the|(?<!llama )(?<!pregunta )a|an|der|die|das|le|la|el|queue|that|i think)\s*$"),
}
AGAINST_AFTER = {
    "email": re.compile(r":[^\s/]+/|:\d|/"),
    "phone": re.compile(rf"(?i)\s*(?:{_TOLD}|(?:{_COUNTED})\b)"),
    "identity": re.compile(rf"(?i)\s*(?:{_TOLD}|(?:{_COUNTED})\b)"),
    "address": re.compile(rf"(?i)\s*(?:(?:{_COUNTED}|milestone|release|project|pattern|team)\b)"),
    "name": re.compile(r"\s(?:[Mm]ilestone|[Pp]roject|[Tt]eam|Pattern|Period|Street|Queue|Bridge|Inc|Ltd|GmbH|Corp|Road|Lane|Avenue|Court)\b"),
}


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % SLOTS


def features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Hashed letter groups of the span's words, its shape and the words beside it."""
    words = text[a:b].split()
    out = {f"n{len(words)}"}
    for i, w in enumerate(words[:6]):
        low = w.lower().strip(".,")
        at = "f" if i == 0 else "l"
        out |= {f"{at}p{low[:3]}", f"{at}s{low[-3:]}", f"{at}s{low[-4:]}", f"{at}w{low}"}
        out.add("c" + re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in w)))
    left, right = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
    out |= {"b" + (left[-1].lower() if left else "^"), "a" + (right[0].lower() if right else "$")}
    out |= {"bc" + text[max(0, a - 1) : a], "ac" + text[b : b + 1]}
    return sorted({_hash(kind + x) for x in out})


def _sentence_begins(text: str, a: int) -> bool:
    i = a
    while i and text[i - 1] in " \t":
        i -= 1
    return i == 0 or text[i - 1] in ".!?:;\n。！？…"


def _names(text: str) -> Iterator[tuple[int, int, dict]]:
    """Candidate names with the labelers' votes on form and gazetteer."""
    for m in NAMES.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        words = text[a:b].replace("-", " ").split()
        if kind == "one":
            if words[0] not in _G:
                # any other capitalised word may be a name where one is announced; what it is worth is estimated
                if words[0] not in _COMMON and len(words[0]) > 2 and CUE.search(text[max(0, a - 30) : a]):
                    yield a, b, {"form": 0, "gazetteer": 0, "against": 0}
                continue
            doubtful = words[0] in _COMMON or words[0].lower() in _WORDS
            begins = doubtful and _sentence_begins(text, a)
            plain = doubtful and regex.match(r"\s\p{Ll}", text, pos=b)
            yield a, b, {"form": -1 if begins else int(not doubtful), "gazetteer": 1, "against": -1 if begins and plain else 0}
            continue
        if kind in ("first", "initial"):
            spaced = [(x.start(), x.end(), x.group()) for x in re.finditer(r"\S+", text[a:b])]
            while len(spaced) > 1 and spaced[0][2] in _COMMON and not (spaced[0][2] in _G and spaced[1][2] not in _COMMON and not spaced[1][2] in _G):
                spaced.pop(0)
            if len(spaced) > 1 and spaced[0][2] not in _G and CUE.fullmatch(spaced[0][2] + " "):
                spaced.pop(0)
            given = [i for i, x in enumerate(spaced) if x[2] in _G]
            if given and given[0] and given[0] < len(spaced) - 1:
                spaced = spaced[given[0] :]
            while len(spaced) > 1 and spaced[-1][2] in _COMMON and not (len(spaced) == 2 and spaced[0][2] in _G):
                spaced.pop()
            a, b = a + spaced[0][0], a + spaced[-1][1]
            names = [x[2] for x in spaced]
            if len(names) == 1:
                if names[0] in _G and names[0] not in _COMMON | {"May", "Will", "Mark"}:
                    yield a, b, {"form": 0, "gazetteer": 1, "against": 0}
                elif names[0] not in _COMMON and len(names[0]) > 2 and CUE.search(text[max(0, a - 30) : a]):
                    yield a, b, {"form": 0, "gazetteer": 0, "against": 0}
                continue
            common = sum(x in _COMMON for x in names if x not in _G)
            known = any(x in _G for x in names)
            yield a, b, {"form": -1 if common else 1, "gazetteer": 1 if known else 0 if kind == "initial" else -1, "against": -1 if common else 0}
            continue
        if kind == "last":
            given = text[a:b].rsplit(", ", 1)[1].split()[0]
            yield a, b, {"form": 1 if given in _G else 0, "gazetteer": 1 if given in _G else -1, "against": -1 if given in _COMMON - _G else 0}
            continue
        known = words[0].lower() in _LOW
        if known:
            yield a, b, {"form": 0, "gazetteer": 1, "against": 0}
    given, told = [], []
    for m in RUN.finditer(text):  # one pass over the words; the patterns are only tried where one begins
        w = m.group()
        if w in _LOW:
            given.append(LOWER.match(text, m.start()))
        if w.lower() in _LABELS:
            told.append(LABELLED.match(text, m.start()))
    done = 0
    for m in filter(None, given):
        if m.start() >= done:
            done = m.end()
            yield m.start(), m.end(), {"form": int(m.group(1) not in _WORDS), "gazetteer": 1, "against": 0}
    done = 0
    for m in filter(None, told):
        if m.start() < done or any(w.capitalize() in _COMMON for w in m.group("name").split()):
            continue
        done = m.end()
        yield *m.span("name"), {"form": 0, "gazetteer": int(m.group("name").split()[0] in _LOW), "against": 0}
    if not HAN_SIGN.search(text):
        return
    for m in HAN.finditer(text):
        cued = regex.search(rf"(?:{_HAN_CUE})$", text[max(0, m.start() - 4) : m.start()])
        if m.lastgroup == "family" and not cued and not regex.match(r"[\"'<>,(;/|、]|\s?[<(]|$", text, pos=m.end()):
            continue
        if m.lastgroup == "cued" and not (BEFORE["name"].search(text[max(0, m.start() - 30) : m.start()]) and regex.match(r"\W|\p{Hiragana}|[为请没每我空旧新共说在和的]|$", text, pos=m.end())):
            continue
        known = m.lastgroup == "known" and m.end() - m.start() >= 3 or m.lastgroup == "family" and bool(cued)
        yield m.start(), m.end(), {"form": int(known), "gazetteer": int(known), "against": 0}


def _inside(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x <= a and b <= y for x, y in spans)


DIGITS = re.compile(r"\d")


def candidates(text: str) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(kind, start, end, votes, features) of every candidate of a text; votes are 1, -1 or 0 (abstains) by LABELERS."""
    plain = text.translate(WIDE)
    found: list[tuple[int, int, int, dict]] = []
    mails: list[tuple[int, int]] = []
    done = 0
    for anchor in AT.finditer(text):
        if anchor.start() < done:
            continue
        m = EMAIL.search(text, max(done, anchor.start() - LOCAL), anchor.end() + LOCAL)
        while m is not None:
            done = m.end()
            mails.append(m.span())
            low = m.group().lower()
            ends = low.rsplit(".", 1)[-1]
            code = -1 if low.startswith("git@") or ends in ("py", "js", "json", "md", "toml", "yaml", "route", "fixture") else 0
            found.append((0, *m.span(), {"form": 1, "gazetteer": 0, "against": code}))
            m = None if done > anchor.start() else EMAIL.search(text, done, anchor.end() + LOCAL)
    numbers: list[tuple[int, int]] = []
    places: list[tuple[int, int]] = []
    if DIGITS.search(plain):
        for i, pattern in enumerate(ADDRESS):
            for m in pattern.finditer(plain):
                a, b = m.start(), TAIL.match(plain, m.end()).end()
                if not any(x < b and a < y for x, y in places):
                    places.append((a, b))
                    lone = bool(regex.match(r"[\d\s]*\p{Ll}+\s(?:way|close|row|place|court|drive|st|dr|av|ter)\b", m.group())) if i == 0 else False
                    found.append((3, a, b, {"form": 0 if lone else 1, "gazetteer": 0, "against": 0}))
        runs = [m.span() for m in NUMBERS.finditer(plain) if sum(map(str.isdigit, m.group())) >= 6]
        for k, pattern, strict in [(2, *f) for f in IDENTITY] + [(1, *f) for f in PHONE]:
            for m in (m for lo, hi in runs for m in pattern.finditer(plain, lo, hi + 3)):
                a, b = m.span()
                if any(x < b and a < y for x, y in numbers) or _inside(places, a, b) or _inside(mails, a, b):
                    continue
                digits = sum(c.isdigit() for c in plain[a:b])
                if k == 1 and not 8 <= digits <= 15:
                    continue
                numbers.append((a, b))
                found.append((k, a, b, {"form": strict, "gazetteer": 0, "against": 0}))
    taken: list[tuple[int, int]] = []
    for a, b, votes in _names(text):
        if _inside(mails, a, b) or any(x < b and a < y for x, y in places) or any(x < b and a < y for x, y in taken):
            continue
        taken.append((a, b))
        found.append((4, a, b, votes))
    spans = sorted((a, b) for _, a, b, _ in found)
    out = []
    for k, a, b, votes in found:
        kind = KINDS[k]
        before, after = plain[max(0, a - 60) : a], plain[b : b + 40]
        line = before.rsplit("\n", 1)[-1] if kind != "name" else before[-30:]
        votes["before"] = 1 if BEFORE[kind].search(line) else 0
        votes["after"] = 1 if AFTER[kind].match(after) else 0
        if AGAINST_BEFORE[kind].search(line) and not (kind == "name" and votes["before"] and votes["gazetteer"] > 0) or AGAINST_AFTER[kind].match(after):
            votes["against"] = -1
        edge = (plain[a - 1 : a], plain[b : b + 1])
        votes["whole"] = -1 if edge[0] in ("-", "_", "/", "\\", "#") and edge[0] or edge[1] in ("_", "\\") and edge[1] else 0
        close = any(x != a and (0 <= a - y < NEAR or 0 <= x - b < NEAR) for x, y in spans)
        votes["near"] = 1 if close else 0
        out.append((k, a, b, [votes[x] for x in LABELERS], features(text, kind, a, b)))
    return out


# --- aggregation of the votes -----------------------------------------------------------------------------------------


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, np.ndarray, dict]:
    """(share of true candidates, vote shares by [labeler, truth, vote + 1], probability of each pattern) of one kind, from
    (votes, count), with the expected vote shares as earlier candidates of either truth. A kind with the same shares of patterns
    is judged alike whether it has thousands of candidates or millions."""
    votes = np.array([p for p, _ in patterns]) + 1
    count = np.array([n for _, n in patterns], dtype=float)
    weight = EXPECTED_WEIGHT + EXPECTED_SHARE * count.sum()
    expected = np.array([EXPECTED[x] for x in LABELERS])[:, ::-1]  # false, true
    table, share, at = expected.copy(), 0.6, np.arange(len(LABELERS))
    for _ in range(rounds):
        log = np.log(table)
        odds = np.log(share / (1 - share)) + (log[at, 1, votes] - log[at, 0, votes]).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
        for y, w in ((0, count * (1 - p)), (1, count * p)):
            seen = np.stack([(w[:, None] * (votes == v)).sum(axis=0) for v in range(3)], axis=1)
            table[:, y] = (seen + weight * expected[:, y]) / (w.sum() + weight)
        share = float((count @ p + 0.6 * weight) / (count.sum() + weight))
    return share, table, dict(zip([q for q, _ in patterns], p.tolist()))


def train(rows: list[tuple[tuple[int, ...], list[int], float]], rounds: int = 200, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic classifier: three a labeler, then the hashed slots, then the constant; targets are soft."""
    base = 3 * len(LABELERS)
    weights = np.zeros(base + SLOTS + 1)
    if not rows:
        return weights
    index, owner = [], []
    for i, (votes, slots, _) in enumerate(rows):
        own = [3 * j + v + 1 for j, v in enumerate(votes)] + [base + s for s in slots] + [base + SLOTS]
        index += own
        owner += [i] * len(own)
    index, owner = np.array(index), np.array(owner)
    target = np.array([t for _, _, t in rows])
    scale = np.zeros_like(weights)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(owner, weights[index], len(rows))))
        gradient = np.bincount(index, (p - target)[owner], len(weights)) / len(rows) + 1e-5 * weights
        scale += gradient * gradient
        weights -= rate * gradient / (np.sqrt(scale) + 1e-8)
    return weights


def chances(weights: np.ndarray, kind: np.ndarray, votes: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The classifiers' (rows of ``weights``, by kind) answers for candidates: their votes in rows, their ``counts`` of slots one after
    the other; one product over all of them."""
    base = 3 * len(LABELERS)
    owner = np.repeat(np.arange(len(kind)), counts)
    z = weights[kind, base + SLOTS] + weights[kind[:, None], 3 * np.arange(len(LABELERS)) + votes + 1].sum(axis=1)
    z += np.bincount(owner, weights[kind[owner], base + slots], len(kind))
    return 1 / (1 + np.exp(-z))


def resolve(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The (kind, start, end) kept of accepted (kind, start, end, chance): none inside or across another of an earlier kind
    or, of one kind, of a longer one."""
    kept: list[tuple[int, int, int]] = []
    for k, a, b, _ in sorted(spans, key=lambda s: (s[0] == 4, -s[3] if s[0] != 4 else 0, -(s[2] - s[1]), s[1])):
        if not any(x < b and a < y for _, x, y in kept):
            kept.append((k, a, b))
    return sorted(kept, key=lambda s: s[1])


# --- plans ------------------------------------------------------------------------------------------------------------

CANDIDATE = "array<struct<k:int,a:int,b:int,votes:array<int>,slots:array<int>>>"


def candidate_rows(texts: DataFrame) -> DataFrame:
    """(src, row_id, found): the candidates of each text that has any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("votes", pa.list_(pa.int32())), ("slots", pa.list_(pa.int32()))])
        for batch in batches:
            keep, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = candidates(text) if text else []
                if found:
                    keep.append(i)
                    out.append([{"k": k, "a": a, "b": b, "votes": v, "slots": s} for k, a, b, v, s in found])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("src").take(at), batch.column("row_id").take(at), pa.array(out, pa.list_(kind))],
                names=["src", "row_id", "found"],
            )

    return texts.select("src", "row_id", "text").mapInArrow(find, f"src string, row_id long, found {CANDIDATE}")


def fit(found: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], list[dict]]:
    """The span classifiers by kind, and what was estimated about the labelers.

    The driver sees the counts of vote patterns (at most 3 to the number of labelers a kind) and at most ``sample``
    candidates a kind, those with the smallest hashes.
    """
    each = found.select("src", "row_id", F.explode("found").alias("c")).select("src", "row_id", "c.*")
    rows = each.groupBy("k", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    models, notes = [], []
    for k, kind in enumerate(KINDS):
        patterns = sorted((tuple(r["votes"]), r["n"]) for r in rows if r["k"] == k)
        if not patterns:
            models.append(train([]))
            notes.append({"kind": kind, "candidates": 0})
            continue
        share, table, chances = estimate(patterns)
        picked = (
            each.where(F.col("k") == k)
            .select("votes", "slots", F.xxhash64("src", "row_id", "a").alias("h"))
            .orderBy("h")
            .limit(sample)
            .collect()
        )
        models.append(train([(tuple(r["votes"]), r["slots"], chances[tuple(r["votes"])]) for r in picked]))
        notes.append(
            {"kind": kind, "candidates": sum(n for _, n in patterns), "share": share}
            | dict(zip(LABELERS, table.round(3).tolist()))
        )
    return models, notes


def mentions(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (src, row_id, kind, start_at, end_at): the personal data in (src, row_id, text), offsets in code points.

    Null and empty texts have none; each row is judged by itself, so repeated rows give repeated mentions; whole texts are
    read whatever their length. Candidates are written once to the shared folder, then counted, sampled and judged.
    """
    found = cut(candidate_rows(texts), "candidates")
    models, _ = fit(found, sample)
    weights = np.stack(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("found").flatten()
            kind, start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", "a", "b"))
            votes = flat.field("votes").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(LABELERS))
            slots, counts = flat.field("slots").flatten().to_numpy(zero_copy_only=False), flat.field("slots").value_lengths().to_numpy(zero_copy_only=False)
            p = chances(weights, kind, votes, slots, counts)
            row = np.repeat(np.arange(batch.num_rows), batch.column("found").value_lengths().to_numpy(zero_copy_only=False))
            own: dict[int, list] = {}
            for i in np.flatnonzero(p >= 0.5).tolist():
                own.setdefault(int(row[i]), []).append((int(kind[i]), int(start[i]), int(end[i]), float(p[i])))
            kept = [(r, *m) for r, spans in own.items() for m in resolve(spans)]
            rows, kinds, starts, ends = zip(*kept) if kept else ((), (), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("src").take(at), batch.column("row_id").take(at), pa.array([KINDS[k] for k in kinds], pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["src", "row_id", "kind", "start_at", "end_at"],
            )

    return found.mapInArrow(judge, "src string, row_id long, kind string, start_at long, end_at long")


def reliabilities(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (kind, labeler, truth, vote, expected, estimated): the share of each vote on true and on false candidates, as expected
    beforehand and as estimated from these texts."""
    _, notes = fit(cut(candidate_rows(texts), "candidates"), sample)
    rows = [
        (n["kind"], x, bool(y), v - 1, float(EXPECTED[x][1 - y][v]), float(n[x][y][v]))
        for n in notes if "share" in n for x in LABELERS for y in (0, 1) for v in range(3)
    ]
    return texts.sparkSession.createDataFrame(rows, "kind string, labeler string, truth boolean, vote int, expected double, estimated double")


def masked(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(src, row_id, text) with every mention of ``found`` replaced by its kind in capitals in square brackets."""
    spans = found.groupBy("src", "row_id").agg(F.array_sort(F.collect_set(F.struct("start_at", "end_at", "kind"))).alias("m"))
    piece = F.transform(
        "m",
        lambda x, i: F.concat(
            F.expr("substring(text, 1, 0)"),
            F.substring("text", F.when(i == 0, F.lit(1)).otherwise(F.get("m", i - 1)["end_at"] + 1), F.greatest(F.lit(0), x["start_at"] - F.when(i == 0, F.lit(0)).otherwise(F.get("m", i - 1)["end_at"]))),
            F.lit("["),
            F.upper(x["kind"]),
            F.lit("]"),
        ),
    )
    tail = F.substring("text", F.element_at("m", -1)["end_at"] + 1, F.length("text"))
    return texts.join(spans, ["src", "row_id"], "left").select(
        "src", "row_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.concat(F.array_join(piece, ""), tail)).alias("text")
    )
