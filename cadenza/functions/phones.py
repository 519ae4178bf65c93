"""Phone inventories, label folding and manner classes, as small dimension tables.

The values below are fixed: published phone sets and foldings (the 61-symbol set folded to 39, ARPABET without stress, IPA) in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the classes of the 39 canonical symbols, coarse (display) classes first
MANNER = {
    "silence": "sil",
    "stop": "b d g p t k dx",
    "fricative": "ch jh s sh z f th v dh hh",
    "nasal": "m n ng",
    "liquid": "l r w y",
    "vowel": "aa ae ah aw ay eh er ey ih iy ow oy uh uw",
}
# fixed values: the finer classes that decide whether two phones agree
MANNER8 = {
    "silence": "sil",
    "stop": "b d g p t k dx",
    "sibilant_affricate": "s sh z ch jh",
    "fricative": "f th v dh hh",
    "nasal": "m n ng",
    "approximant": "l w y",
    "rhotic": "r er",
    "vowel": "aa ae ah aw ay eh ey ih iy ow oy uh uw",
}
# fixed values: labels and the canonical symbols they fold into; nothing after the colon deletes the label. The 61-symbol set
TIMIT = """
aa:aa ao:aa ae:ae ah:ah ax:ah ax-h:ah aw:aw ay:ay b:b bcl:sil ch:ch d:d dcl:sil dh:dh dx:dx eh:eh el:l em:m en:n nx:n eng:ng epi:sil er:er axr:er ey:ey f:f g:g gcl:sil hh:hh hv:hh
ih:ih ix:ih iy:iy jh:jh k:k kcl:sil l:l m:m n:n ng:ng ow:ow oy:oy p:p pcl:sil pau:sil h#:sil q: r:r s:s sh:sh zh:sh t:t tcl:sil th:th uh:uh uw:uw ux:uw v:v w:w y:y z:z
"""
# fixed values: ARPABET without stress, and what systems that use it write for silence; the last entry is the empty label
ARPABET = """
aa:aa ao:aa ae:ae ah:ah ax:ah aw:aw ay:ay b:b ch:ch d:d dh:dh dx:dx eh:eh er:er axr:er ey:ey f:f g:g hh:hh ih:ih ix:ih iy:iy jh:jh k:k l:l el:l m:m em:m n:n en:n nx:n ng:ng eng:ng
ow:ow oy:oy p:p r:r s:s sh:sh zh:sh t:t th:th uh:uh uw:uw ux:uw v:v w:w y:y z:z sil:sil sp:sil spn:sil h#:sil pau:sil [sil]:sil [noise]:sil [unk]: [pad]: :sil
"""
# fixed values: what conversational annotation has besides ARPABET, in its own spellings and in those that events are renamed to
BUCKEYE = """
tq: SIL:sil !sil:sil noise:sil NOISE:sil vocnoise:sil VOCNOISE:sil [vocalized-noise]:sil laugh:sil LAUGH:sil [laughter]:sil unknown: UNKNOWN: iver: IVER: <exclude-name>: excluded:
"""
# fixed values: IPA symbols
IPA = """
i:iy iː:iy ɪ:ih e:ey eɪ:ey ɛ:eh æ:ae ə:ah ʌ:ah ɐ:ah ɑ:aa ɑː:aa ɒ:aa ɔ:aa ɔː:aa o:ow oʊ:ow əʊ:ow ʊ:uh u:uw uː:uw aɪ:ay aʊ:aw ɔɪ:oy ɝ:er ɚ:er ɜ:er ɜː:er ɹ̩:er
p:p b:b t:t d:d k:k g:g ɡ:g tʃ:ch dʒ:jh f:f v:v θ:th ð:dh s:s z:z ʃ:sh ʒ:sh h:hh m:m n:n ŋ:ng l:l ɫ:l r:r ɹ:r w:w j:y ʔ: ɾ:dx ˈ: ˌ:
ɑːɹ:er ʊɹ:er ɔːɹ:er ɪɹ:er oːɹ:er ɛɹ:er aɪɚ:er ɑɹ:er ɔɹ:er ɜːɹ:er əɹ:er ʊəɹ:er ɛəɹ:er ɪəɹ:er aʊɹ:er əl:l l̩:l n̩:n m̩:m ŋ̍:ng ᵻ:ih ɨ:ih iə:iy oː:ow aɪə:ay eə:eh ʉ:uw tʃɹ:ch
-: sil:sil sp:sil spn:sil [SIL]:sil :sil
"""
# fixed values: word labels that stand for silence
SILENCE_WORDS = ("", "sil", "sp", "spn", "silence", "<sil>", "[sil]")

#: How a source's labels are made keys: lower case without a trailing stress digit, lower case, or only trimmed.
STRESS, LOWER, PLAIN = "stress", "lower", "plain"


def read_table(text: str) -> dict[str, str | None]:
    """``label:symbol`` entries; a label without a symbol is deleted."""
    return {label: to or None for label, _, to in (x.rpartition(":") for x in text.split())}


_ARPABET = read_table(ARPABET)
#: (accent, source) -> its table and how its labels are made keys. ``register_source`` adds to it.
_HELD: dict[tuple[str, str], tuple[dict[str, str | None], str]] = {
    ("us", "timit61"): (read_table(TIMIT), LOWER),
    ("us", "timit"): (read_table(TIMIT), LOWER),
    ("us", "buckeye"): (_ARPABET | read_table(BUCKEYE), PLAIN),
    **{("us", source): (_ARPABET, STRESS) for source in ("arpabet", "l2arctic", "mfa", "torchaudio", "whisperx")},
    **{("us", source): (read_table(IPA), PLAIN) for source in ("ipa", "charsiu")},
}


def register_source(source: str, table: dict[str, str | None], keys: str = PLAIN, accent: str = "us") -> None:
    if (accent, source) in _HELD:
        raise ValueError(f"label source {source!r} exists for accent {accent!r}")
    _HELD[accent, source] = (table, keys)


def sources(accent: str = "us") -> dict[str, tuple[dict[str, str | None], str]]:
    """The tables of an accent; an accent without any is an error."""
    found = {source: held for (a, source), held in _HELD.items() if a == accent}
    if not found:
        raise ValueError(f"no label sources for accent {accent!r}; known: {sorted({a for a, _ in _HELD})}")
    return found


def label_map(spark: SparkSession, accent: str = "us") -> DataFrame:
    """source, key, canonical (null: delete on purpose). A label without a row is unmapped."""
    rows = [(source, key, to) for source, (table, _) in sources(accent).items() for key, to in table.items()]
    return spark.createDataFrame(rows, "source string, key string, canonical string")


def manner_map(spark: SparkSession) -> DataFrame:
    """label, manner, manner8 of the canonical symbols."""
    fine = {s: m for m, group in MANNER8.items() for s in group.split()}
    return spark.createDataFrame([(s, m, fine[s]) for m, group in MANNER.items() for s in group.split()], "label string, manner string, manner8 string")


def _lookup(label: Column, classes: dict[str, str]) -> Column:
    out = None
    for name, symbols in classes.items():
        if name != "silence":
            hit = label.isin(*symbols.split())
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("silence")


def manner(label: Column) -> Column:
    """Coarse class of a canonical symbol; unknown labels and what lies beyond a tier's ends are silence."""
    return _lookup(label, MANNER)


def manner8(label: Column) -> Column:
    return _lookup(label, MANNER8)


def norm_key(label: Column, source: Column, accent: str = "us") -> Column:
    """Look-up key of a label, as its source makes them; labels of unknown sources are only trimmed."""
    trimmed, held = F.trim(label), sources(accent)
    of = lambda keys: [s for s, (_, k) in held.items() if k == keys]
    return F.when(source.isin(*of(STRESS)), F.regexp_replace(F.lower(trimmed), "[0-2]$", "")).when(source.isin(*of(LOWER)), F.lower(trimmed)).otherwise(trimmed)


# fixed values: categories of the labels systems and references write, by the family of labels; ARPABET vowels come plain and with stress 0 to 2
ARPA_VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW"
ARPA_OTHERS = {"stop": "B,P,D,T,G,K", "approximant": "R,L,Y,W", "nasal": "M,N,NG", "fricative": "DH,TH,HH,F,V", "sibilant": "S,SH,Z,ZH,CH,JH"}
ARPA_SILENCE = {"arpa": "sil", "charsiu": "sil,[SIL],sil [SIL],[SIL] sil", "maps": "sil,H#"}
BOURNEMOUTH = {
    "vowel": "a,a:,æ,aɪ,aʊ,ɔ,ɔɪ,e,ə,ɚ,eɪ,ɛ,i,ɪ,i:,j e,j ɛ,j o,j u,j ʌ,ɯ,o,o:,oʊ,u,ʊ,u:,ʌ,w e,w ɛ,w i,w ʌ", "stop": "b,d,g,k,p,q,t", "approximant": "j,l,ɹ,ɾ,w", "nasal": "m,n,ŋ", "fricative": "ç,ð,f,h,v,θ",
    "sibilant": "ɕ,s,ʃ,z,ʒ,dʒ,ts,tʃ", "silence": "sil",
}
REFERENCE_VOWELS = "aa,aan,ao,aon,ae,aen,ah,ahn,aw,awn,ay,ayn,eh,ehn,er,ern,ey,eyn,ih,ihn,iy,iyn,ow,own,oy,oyn,uw,uwn,uh,uhn,ih r,iy r"
REFERENCE_OTHERS = {"approximant": "el,l,r,y,w", "nasal": "en,n,nx,em,m,eng,ng", "sibilant": "s,z,sh,zh,ch,jh"}
REFERENCE = {
    "timit": {"vowel": REFERENCE_VOWELS + ",ax,ax-h,ix,ux,axr", "stop": "dx,b,p,t,d,k,g,q,bcl,pcl,tcl,tcl q,dcl,kcl,gcl,t w,g w,k w,d w,p w,b w", "fricative": "th,dh,f,v,hh,hv", "silence": "sil,h#"} | REFERENCE_OTHERS,
    "buckeye": {"vowel": REFERENCE_VOWELS, "stop": "b,p,t,d,k,g,dx,tq", "fricative": "th,dh,f,v,hh", "silence": "sil,SIL,!sil"} | REFERENCE_OTHERS,
}
RHOTIC_TEST, RHOTIC_REFERENCE, UNKNOWN, EDGE = ("ER0", "ER1", "ER2", "R"), ("axr", "r", "er"), "unknown", "<utterance_edge>"


def category_rows() -> list[tuple[str, str, str, str]]:
    """(side, family, label, category): reference labels by corpus, test labels by the family of systems."""
    vowels = ",".join(v + stress for v in ARPA_VOWELS.split() for stress in ("", "0", "1", "2"))
    tables = [("ref", corpus, t) for corpus, t in REFERENCE.items()] + [("test", "bournemouth", BOURNEMOUTH)]
    tables += [("test", family, {"vowel": vowels, "silence": silence} | ARPA_OTHERS) for family, silence in ARPA_SILENCE.items()]
    return [(side, family, label, category) for side, family, table in tables for category, labels in table.items() for label in labels.split(",")]


def category_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(category_rows(), "side string, family string, label string, category string")
