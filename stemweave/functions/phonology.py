"""The sound of a form as seventeen numbers, from its pronunciation or else its spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols of the phonetic alphabet by class, and where each vowel is said (openness and frontness).
AFFRICATES = "tʃ dʒ ts dz tɕ dʑ ʈʂ ɖʐ tθ dð".split()
ASPIRATED = "pʰ tʰ kʰ cʰ qʰ ʈʰ tsʰ tʃʰ tɕʰ".split()
SOFTENED = "tʲ dʲ sʲ lʲ rʲ nʲ pʲ bʲ fʲ vʲ".split()
ROUNDED = "kʷ gʷ qʷ".split()
THROATED = "tˤ dˤ sˤ ðˤ ɫˤ".split()
EJECTIVE = "kʼ tʼ pʼ qʼ tsʼ".split()
DIPHTHONGS = "aɪ eɪ ɔɪ aʊ oʊ ɪə ʊə eə ai ei au oi ou iu ie uo".split()
STOPS = [*"pbtdʈɖcɟkgqɢʔ", *AFFRICATES, *ASPIRATED, *"tʲ dʲ pʲ bʲ".split(), *ROUNDED, "tˤ", "dˤ", *EJECTIVE]
NASALS = [*"mnɲŋɴɱɳ", "nʲ"]
LATERALS = [*"lɭʎʟɬɮ", "lʲ", "ɫˤ"]
RHOTICS = [*"rɾɽɹɻʀʁ", "rʲ"]
FRICATIVES = [*"fvθðszʃʒçʝxɣχʁħʕhɦɸβʂʐɕʑɬɮ", "sʲ", "fʲ", "vʲ", "sˤ", "ðˤ"]
APPROXIMANTS = [*"wjɥɰʋ"]
SIBILANTS = [*"szʃʒʂʐɕʑ", *"tʃ dʒ ts dz tɕ dʑ ʈʂ ɖʐ tʃʰ tsʰ tɕʰ tsʼ sʲ sˤ".split()]
PALATALS = [*"ɲʎçʝjɕʑcɟ", *"tʃ dʒ tɕ dʑ tʃʰ tɕʰ".split(), *SOFTENED, "cʰ"]
RETROFLEXES = [*"ʈɖɳɽɻʂʐɭ", "ʈʂ", "ɖʐ", "ʈʰ"]
PHARYNGEALS = [*"ħʕʢʡχ", *THROATED, "qˤ", "q"]
OPENNESS = {-1.0: "iyɨʉɯu", -0.7: "ɪʏʊ", -0.3: "eøɘɵɤo", 0.0: "ə", 0.3: "ɛœɜɞʌɔ", 0.7: "æɐ", 1.0: "aɶɑɒ"}
FRONTNESS = {1.0: "iyeøɛœæaɶ", 0.7: "ɪʏ", 0.0: "ɨʉɘɵəɜɞɐ", -0.7: "ʊ", -1.0: "ɯuɤoʌɔɑɒ"}
TENSE, LAX = "iueoyøɵɤɨʉɯɶɑ", "ɪʊɛɔæʌʏɜɞɐ"
MARKS = "ˈˌːˑ·."
SPELT = {"vowels": "aeiouy", "stops": "pbtdkgq", "sibilants": "szx", "soft": "fvszhlrmn", "laterals": "lmn", "rhotics": "r"}

VOWELS = [v for group in OPENNESS.values() for v in group]
CONSONANTS = list(dict.fromkeys([*STOPS, *NASALS, *LATERALS, *RHOTICS, *FRICATIVES, *APPROXIMANTS, *RETROFLEXES, *PHARYNGEALS]))
PHONEME = "|".join(sorted({*AFFRICATES, *ASPIRATED, *SOFTENED, *ROUNDED, *THROATED, *EJECTIVE, *DIPHTHONGS}, key=lambda s: (-len(s), s))) + "|[\\s\\S]"
FEATURES = [
    "cluster_density", "final_fortition", "final_cluster_rate", "vowel_final_bias", "soft_consonants", "polysyllabic_bias", "palatalization", "sibilance", "retroflexion", "pharyngeal",
    "vowel_height", "vowel_backness", "stop_vs_continuant", "aspirated_voiceless", "liquid_l_m_n", "rhotic_r", "vowel_tenseness",
]


def phonemes(ipa: Column) -> Column:
    """The sounds of a pronunciation (composed characters), without brackets, stress and length; combinations that are one sound are kept together."""
    bare = F.regexp_replace(F.trim(ipa), r"^(/)([\s\S]*)/$|^\[([\s\S]*)\]$", "$2$3")
    return F.regexp_extract_all(F.translate(F.trim(bare), MARKS, ""), F.lit(f"({PHONEME})"), F.lit(1))


def _mean(items: Column, values: dict[float, str]) -> Column:
    case = F.lit(0.0)
    size = F.size(items)

    def of(x):
        out = case
        for v, group in values.items():
            out = F.when(x.isin(*group), v).otherwise(out)
        return out

    return F.when(size > 0, F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x)) / size).otherwise(0.0)


def _measures(sounds: Column, letters: Column, vowel, consonant, stops, soft, continuants) -> dict[str, Column]:
    """What both ways of reading a form have in common."""
    n = F.size(sounds)
    among = F.filter(sounds, consonant)
    many = lambda test, of=sounds: F.size(F.filter(of, test))
    beside = lambda i: F.coalesce(consonant(F.get(sounds, i)), F.lit(False))
    joined = F.size(F.filter(F.transform(sounds, lambda x, i: consonant(x) & (((i > 0) & beside(i - 1)) | beside(i + 1))), lambda b: b))
    last = F.get(sounds, n - 1)
    hard, lasting = many(stops, among), many(continuants, among)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "cluster_density": joined / n, "final_fortition": yes(stops(last)), "final_cluster_rate": yes((n > 1) & consonant(last) & beside(n - 2)), "vowel_final_bias": yes(vowel(last)),
        "soft_consonants": F.when(F.size(among) > 0, many(soft, among) / F.size(among)).otherwise(0.0), "polysyllabic_bias": F.when(letters > 0, F.least(F.lit(1.0), many(vowel) / letters)).otherwise(0.0),
        "stop_vs_continuant": F.when(hard + lasting > 0, (hard - lasting) / (hard + lasting)).otherwise(0.0),
    }


def sound_vector(form: Column, ipa: Column) -> Column:
    """A struct of the seventeen ``FEATURES``: shares between 0 and 1, and signed ones between -1 and 1.

    A pronunciation is read by its sounds.  Where it is null or blank the letters of the form stand for sounds; what letters don't tell is 0 then.  A form without letters or sounds has zeros.
    """
    p = phonemes(ipa)
    is_in = lambda members: lambda x: x.isin(*members)
    vowel = lambda x: x.isin(*VOWELS) | ((F.length(x) == 2) & F.left(x, F.lit(1)).isin(*VOWELS))
    continuants = [*FRICATIVES, *APPROXIMANTS, *LATERALS, *RHOTICS, *NASALS]
    heard = _measures(p, F.length(F.coalesce(form, F.lit(""))), vowel, is_in(CONSONANTS), is_in(STOPS), is_in(continuants), is_in(continuants))
    share = lambda members: F.size(F.filter(p, is_in(members))) / F.size(p)
    single = F.filter(p, is_in(VOWELS))
    heard |= {"palatalization": share(PALATALS), "sibilance": share(SIBILANTS), "retroflexion": share(RETROFLEXES), "pharyngeal": share(PHARYNGEALS), "aspirated_voiceless": share(ASPIRATED), "liquid_l_m_n": share([*LATERALS, *NASALS]), "rhotic_r": share(RHOTICS)}
    heard |= {"vowel_height": _mean(single, OPENNESS), "vowel_backness": _mean(single, FRONTNESS), "vowel_tenseness": _mean(single, {1.0: TENSE, -1.0: LAX})}

    q = F.regexp_extract_all(F.coalesce(form, F.lit("")), F.lit(r"(\p{L})"), F.lit(1))
    spelt = lambda k: is_in([*SPELT[k], *SPELT[k].upper()])
    read = _measures(q, F.length(F.coalesce(form, F.lit(""))), spelt("vowels"), lambda x: ~spelt("vowels")(x), spelt("stops"), spelt("soft"), spelt("soft"))
    part = lambda k: F.size(F.filter(q, spelt(k))) / F.size(q)
    read |= {"sibilance": part("sibilants"), "liquid_l_m_n": part("laterals"), "rhotic_r": part("rhotics")}

    said = F.coalesce(F.size(p) > 0, F.lit(False))
    one = lambda k: F.when(said, heard[k]).when(F.size(q) > 0, read.get(k, F.lit(0.0))).otherwise(0.0)
    return F.struct(*[one(k).cast("double").alias(k) for k in FEATURES])
