"""Listing text as columns: tokens, names, identities.

listings: listing_id, store, brand, name, volume_ml, concentration, ... Each expression is built-in
SQL over arrays; tokenize_listings computes them once per listing so that pair rules never parse text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.fixed import DEFAULT, Lexicon
from ..functions.text import (
    expand_set_contents, fold, found, matches, repair_encoding, replace_all, squeeze, title_case, words_array)

STRINGS = "array<string>"


# ------------------------------------------------------------------ distances

def word_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def close_words(a: Column, b: Column) -> Column:
    """The same word, spelling aside."""
    return word_distance(a, b) <= fixed.SAME_WORD_DISTANCE


def same_brand_key(a: Column, b: Column) -> Column:
    """Equal keys; for keys longer than a code also containment or a spelling difference."""
    short = F.least(F.length(a), F.length(b)) <= fixed.SHORT_BRAND_KEY
    loose = F.contains(a, b) | F.contains(b, a) | close_words(a, b)
    return F.when(short, a == b).otherwise(loose)


# ------------------------------------------------------------------ listing text

def name_with_declared_gender(name: Column, declared: Column) -> Column:
    """A declared gender appended as the code its store's names carry."""
    code = F.lit(None).cast("string")
    for gender, mark in fixed.DECLARED_GENDER_CODES.items():
        code = F.when(declared == gender, mark).otherwise(code)
    return F.when(code.isNull(), name).otherwise(F.concat(name, F.lit(" "), code))


def scan_listings(listings: DataFrame, stores: Sequence[str]) -> DataFrame:
    """The listings that matching reads: active, with a vector, of the chosen stores; names repaired, the declared gender in the name.

    listings: listing_id, store, is_active, embedding, raw_name, declared_gender and others, which are kept. Filters come first, so a
    columnar source is pruned by them.
    """
    wanted = listings.where(F.col("is_active") & F.col("embedding").isNotNull() & F.col("store").isin(*stores))
    return repair_encoding(wanted, "raw_name").withColumn("raw_name", name_with_declared_gender(F.col("raw_name"), F.col("declared_gender")))


def name_with_gender_words(store: Column, name: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Store gender codes written as words."""
    written = name
    for shop, codes in lexicon.gender_codes.items():
        replaced = name
        for code, word in codes.items():
            replaced = F.replace(replaced, F.lit(code), F.lit(f" {word} "))
        written = F.when(store == shop, replaced).otherwise(written)
    return squeeze(written)


def listing_text(brand: Column, name: Column) -> Column:
    """Text to embed; inputs are abbreviation-expanded."""
    brand = F.coalesce(brand, F.lit(""))
    text = F.when((brand == "") | F.contains(name, brand), name).otherwise(F.concat(brand, F.lit(" "), name))
    return F.concat(F.lit("query: "), text)


def split_words(expanded: Column, digits: bool = False, lexicon: Lexicon = DEFAULT) -> Column:
    """Tokens of expanded text with spelling synonyms applied; dropped synonyms vanish."""
    text = replace_all(fold(expanded), r"\bde luxe\b", "deluxe")
    tokens = F.regexp_extract_all(text, F.lit("([a-z0-9]+)" if digits else "([a-z]+)"), 1)

    def spelled(word: Column) -> Column:
        chain = word
        for source, target in lexicon.synonyms.items():
            chain = F.when(word == source, target).otherwise(chain)
        return chain

    return F.filter(F.transform(tokens, spelled), lambda w: w != "")


def _in(words) -> Column:
    return words_array(words)


def has(words, word: Column) -> Column:
    return F.array_contains(words_array(words), word) if words else F.lit(False)


def only_gender(words: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The one gender a token list names; null when none or both."""
    male = F.arrays_overlap(words, _in(lexicon.male))
    female = F.arrays_overlap(words, _in(lexicon.female))
    return F.when(male & ~female, "male").when(female & ~male, "female")


def variant_words(words: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Flanker words of a name; long ones tolerate typos, the nearest spelling winning."""
    long_variants = [v for v in lexicon.variants if len(v) >= fixed.VARIANT_TYPO_LENGTH]

    def nearest(word: Column) -> Column:
        scored = F.array(*[F.struct(word_distance(word, F.lit(v)).alias("d"), F.lit(v).alias("v")) for v in long_variants])
        best = F.array_min(F.filter(scored, lambda s: s["d"] <= fixed.SAME_WORD_DISTANCE))
        return (F.when(has(lexicon.variants, word), word)
                .when(F.length(word) >= fixed.VARIANT_TYPO_LENGTH, best["v"]))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.array_distinct(words), nearest))))


def edition_numbers(expanded: Column, is_set: Column) -> Column:
    """Numbers that are part of the name: not sizes, not release years; none for sets."""
    text = replace_all(expanded, fixed.SIZES_IN_NAME, " ")
    text = replace_all(text, fixed.NUMBER_PREFIX, " ")
    numbers = F.regexp_extract_all(text, F.lit(r"(?U)\b(\d+(?:\.\d+)?[a-z]*)"), 1)
    kept = F.filter(numbers, lambda n: ~F.rlike(n, F.lit(r"^20\d\d$")))
    return F.when(is_set, F.array().cast(STRINGS)).otherwise(F.array_sort(F.array_distinct(kept)))


def collection_words(brand_key: Column, lexicon: Lexicon = DEFAULT) -> Column:
    found_words = F.array().cast(STRINGS)
    for brand, words in lexicon.collections.items():
        found_words = F.when(brand_key == brand, _in(words)).otherwise(found_words)
    return found_words


def core_list(words: Column, brand_key: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Identifying tokens, repetitions kept."""
    dropped = F.array_union(_in(lexicon.genders + lexicon.neutral), collection_words(brand_key, lexicon))
    return F.filter(words, lambda w: ~F.array_contains(dropped, w) & ((F.length(w) > 2) | has(lexicon.short_names, w)))


def generic(name_words: Column, brand_words: Column, brand_key: Column, editions: Column,
            lexicon: Lexicon = DEFAULT) -> Column:
    """Nothing identifying beyond brand, format and audience."""
    named = F.filter(name_words, lambda w: (F.length(w) > 2) | has(lexicon.name_gender, w))
    noise = F.array_union(
        F.array_union(_in(lexicon.neutral + lexicon.audience + lexicon.product_types), brand_words),
        collection_words(brand_key, lexicon))
    return (F.size(F.array_except(named, noise)) == 0) & (F.size(editions) == 0)


def identity_core(words: Column, coded_words: Column, brand_words: Column, brand_key: Column,
                  lexicon: Lexicon = DEFAULT) -> Column:
    """Sorted identifying tokens, stricter than core_list: short words and name genders stay, repeats too."""
    skip_short = lexicon.genders + lexicon.neutral + lexicon.identity_noise + lexicon.short_names
    inside = lambda w: F.array_contains(brand_words, w)
    core = F.filter(core_list(words, brand_key, lexicon), lambda w: ~inside(w))
    short = F.filter(coded_words, lambda w: (F.length(w) <= 2) & ~has(skip_short, w) & ~inside(w))
    gendered = F.filter(words, lambda w: has(lexicon.name_gender, w) & ~inside(w))
    return F.array_sort(F.concat(core, short, gendered))


def serialize_identity(brand_key: Column, core: Column, gender: Column, editions: Column) -> Column:
    return F.concat_ws("|", brand_key, F.array_join(core, " "), F.coalesce(gender, F.lit("")), F.array_join(editions, " "))


def listing_tokens(text: Column) -> Column:
    """Letters and numbers apart: "100ml" is two tokens."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit(r"([a-z]+|\d+(?:[.,]\d+)?)"), 1)


def store_words(brand: Column, name: Column, volume_ml: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """What one store must repeat to list a product twice: sorted tokens, repeats kept.

    A brand word is dropped the first time it appears, the listing's own size always.
    """
    text = replace_all(replace_all(name, fixed.AUDIENCE_CODE), fixed.CONCENTRATION_PHRASE, " ", ignore_case=True)
    tokens = listing_tokens(text)
    brands = listing_tokens(F.coalesce(brand, F.lit("")))
    size = volume_ml.cast("string")
    long_filler = [f for f in lexicon.store_filler if len(f) >= 5]

    def filler(word: Column) -> Column:
        typo = F.lit(False)
        for f in long_filler:
            typo = typo | close_words(word, F.lit(f))
        return has(lexicon.store_filler, word) | ((F.length(word) >= 5) & ~has(lexicon.not_filler_typos, word) & typo)

    def own_size(word: Column) -> Column:
        dotted = F.replace(word, F.lit(","), F.lit("."))
        return F.coalesce((volume_ml > 0) & ((dotted == size) | (dotted == F.concat(size, F.lit(".0")))), F.lit(False))

    first_brand_mention = F.filter(
        tokens, lambda w, i: ~(F.array_contains(brands, w) & (F.array_position(tokens, w) == i + 1)))
    kept = F.filter(first_brand_mention, lambda w: ~(
        has(lexicon.store_units + lexicon.audience, w) | filler(w) | own_size(w)))
    return F.array_sort(kept)


def display_name(brand: Column, name: Column, other_brand: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A name without brand, size, format and audience words, in its own order; "" when nothing is left."""
    def split(b: Column) -> Column:
        return F.filter(F.split(squeeze(F.lower(F.coalesce(b, F.lit("")))), " "), lambda w: w != "")

    brands = F.array_union(split(brand), split(other_brand))
    text = replace_all(name, r"\(\w\)")
    text = replace_all(text, r"\s[-–—]\s|\s[-–—]$")
    text = F.replace(replace_all(text, fixed.VOLUME, " ", ignore_case=True), F.lit("+"), F.lit(" "))
    tokens = F.filter(F.split(squeeze(text), " "), lambda t: t != "")
    plain_neutral = [w for w in lexicon.neutral if w not in lexicon.genders and w != "the"]

    def word(token: Column) -> Column:
        return F.lower(F.regexp_replace(token, r"^[.,()]+|[.,()]+$", ""))

    def near_brand(w: Column) -> Column:
        return F.exists(brands, lambda b: (w == b) | ((F.length(w) > 3) & close_words(w, b)))

    kept = F.filter(tokens, lambda t: (word(t) != "") & ~has(lexicon.audience + ("para",), word(t))
                    & ~near_brand(word(t)) & ~has(plain_neutral, word(t)))

    def shown(token: Column) -> Column:
        bare = F.regexp_replace(token, r"^[,()]+|[,()]+$", "")
        shouting = (F.upper(token) == token) & (F.lower(token) != token)
        return F.when(shouting, title_case(bare)).otherwise(bare)

    parts = F.transform(kept, shown)
    named = F.exists(parts, lambda p: F.lower(p) != "the")
    return F.when(named, F.array_join(parts, " ")).otherwise("")


def canonical_name(brand: Column, fragrance: Column, concentration: Column, volume_ml: Column,
                   presentation: Column) -> Column:
    label = F.lit("")
    for code, text in fixed.CONCENTRATION_LABELS.items():
        label = F.when(concentration == code, text).otherwise(label)
    title = F.when(F.lower(F.trim(fragrance)) == F.lower(F.trim(brand)), "").otherwise(fragrance)
    parts = F.filter(F.array(brand, title, label, F.concat(volume_ml.cast("string"), F.lit(" ml"))), lambda p: p != "")
    name = F.array_join(parts, " ")
    return F.when(presentation == "travel_set", F.concat(name, F.lit(" (set)"))).otherwise(name)


def once_per_form(rows: DataFrame, inputs: Sequence[str], compute: Callable[[DataFrame], DataFrame], *marks: Column) -> DataFrame:
    """The rows with the columns that compute adds to its inputs, computed once per distinct form of these. marks: aggregates of a form's rows.

    Only the inputs are shuffled before the text work, which is dealt to as many tasks as the session shuffles into.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = rows.groupBy(*inputs).agg(*marks) if marks else rows.select(*inputs).distinct()
    done = compute(forms.repartition(parts, *inputs))
    added = [c for c in done.columns if c not in inputs]
    forms = done.select(*[F.col(c).alias(f"_{c}") for c in inputs], *added)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in inputs])
    return rows.join(forms, same).select(*rows.columns, *added)


def tokenize_listings(listings: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Every text column the pair rules and identities read, once per written form: name, brand, size, concentration and gender codes of the store.

    `form` is the first listing_id written in that form.
    """
    coded = F.lit(None).cast("string")
    for shop, codes in lexicon.gender_codes.items():
        coded = F.when(F.col("store") == shop, next(s for s, c in lexicon.gender_codes.items() if c == codes)).otherwise(coded)
    inputs = ("brand", "name", "volume_ml", "concentration", "codes_of")
    read = once_per_form(listings.withColumn("codes_of", coded), inputs, lambda forms: _tokenize(
        forms.withColumn("store", F.col("codes_of")), lexicon).drop("store"), F.min("listing_id").alias("form"))
    return read.drop("codes_of")


def _tokenize(listings: DataFrame, lexicon: Lexicon) -> DataFrame:
    brand = F.coalesce("brand", F.lit(""))
    full = F.concat(brand, F.lit(" "), F.col("name"))
    coded_name = name_with_gender_words(F.col("store"), F.col("name"), lexicon)
    base = listings.select(
        "*",
        expand_set_contents(full).alias("_full"),
        expand_set_contents(F.concat(F.lit(" "), F.col("name"))).alias("_name"),
        expand_set_contents(F.concat(F.lit(" "), brand)).alias("_brand"),
        expand_set_contents(F.concat(brand, F.lit(" "), coded_name)).alias("_coded"),
        expand_set_contents(F.concat(brand, F.lit(" "), replace_all(coded_name, fixed.AUDIENCE_CODE))).alias("_short"),
        coded_name.alias("_coded_name"),
    )
    tokens = base.select(
        *listings.columns, "_full", "_coded",
        split_words(F.col("_full"), lexicon=lexicon).alias("words"),
        split_words(F.col("_name"), lexicon=lexicon).alias("name_tokens"),
        split_words(F.col("_brand"), lexicon=lexicon).alias("brand_words"),
        F.array_join(split_words(F.col("_brand"), digits=True, lexicon=lexicon), "").alias("brand_key"),
        split_words(F.col("_coded"), lexicon=lexicon).alias("coded_words"),
        split_words(F.col("_short"), lexicon=lexicon).alias("short_words"),
    )
    flags = tokens.select(
        "*",
        (F.contains("name", F.lit("+")) | F.arrays_overlap("name_tokens", _in(lexicon.set_words))).alias("is_set"),
        only_gender(F.col("words"), lexicon).alias("gender"),
        only_gender(F.col("coded_words"), lexicon).alias("coded_gender"),
        F.array_sort(F.array_distinct(core_list(F.col("words"), F.col("brand_key"), lexicon))).alias("core"),
        F.array_sort(F.array_distinct(core_list(F.col("coded_words"), F.col("brand_key"), lexicon))).alias("coded_core"),
        variant_words(F.col("words"), lexicon).alias("variants"),
    )
    named = flags.select(
        "*",
        edition_numbers(F.col("_full"), F.col("is_set")).alias("editions"),
        edition_numbers(F.col("_coded"), F.col("is_set")).alias("coded_editions"),
        F.array_sort(F.array_union("core", F.filter("words", lambda w: has(lexicon.name_gender, w)))).alias("name_words"),
        identity_core(F.col("coded_words"), F.col("short_words"), F.col("brand_words"), F.col("brand_key"), lexicon)
        .alias("identity_core"),
        store_words(F.col("brand"), F.col("name"), F.col("volume_ml"), lexicon).alias("store_words"),
    ).drop("_full", "_coded")
    identity = serialize_identity(F.col("brand_key"), F.col("identity_core"), F.col("coded_gender"), F.col("coded_editions"))
    presentation = F.when(F.col("is_set"), "travel_set").otherwise("full_bottle")
    return named.select(
        "*",
        generic(F.col("name_tokens"), F.col("brand_words"), F.col("brand_key"), F.col("editions"), lexicon).alias("is_generic"),
        identity.alias("identity"),
        presentation.alias("presentation"),
        product_key(identity, F.col("concentration"), F.col("volume_ml"), presentation).alias("listing_key"),
    )


def product_key(identity: Column, concentration: Column, volume_ml: Column, presentation: Column) -> Column:
    """One text key per product; null without a volume, a missing concentration is a value of its own."""
    key = F.concat_ws("#", identity, F.coalesce(concentration, F.lit("")), volume_ml.cast("string"), presentation)
    return F.when(volume_ml > 0, key)


# ------------------------------------------------------------------ pair text

def without_brand_words(words: Column, brands: Column) -> Column:
    return F.filter(words, lambda w: ~F.exists(brands, lambda b: (w == b) | ((F.length(w) > 3) & close_words(w, b))))


def comparable(words_a: Column, words_b: Column, tokens_a: Column, tokens_b: Column, brands: Column,
               lexicon: Lexicon = DEFAULT) -> tuple[Column, Column]:
    """Two word sets without either brand's words and without a shared format's optional words."""
    a, b = without_brand_words(words_a, brands), without_brand_words(words_b, brands)
    for product_format, optional in lexicon.optional_format.items():
        shared = F.array_contains(tokens_a, product_format) & F.array_contains(tokens_b, product_format)
        a = F.when(shared, F.array_except(a, _in(optional))).otherwise(a)
        b = F.when(shared, F.array_except(b, _in(optional))).otherwise(b)
    return a, b


def drop_compounds(joined: Column, split: Column) -> tuple[Column, Column]:
    """Words written as one on the left and as two on the right leave both sides, in sorted order.

    A fold over the few differing words: each match consumes its two parts.
    """
    zero = F.struct(F.array().cast(STRINGS).alias("kept"), split.alias("split"))

    def rest(word: Column, first: Column) -> Column:
        return F.substring(word, F.length(first) + 1, F.length(word))

    def step(state: Column, word: Column) -> Column:
        firsts = F.filter(state["split"], lambda f: (
            F.startswith(word, f) & (rest(word, f) != f) & F.array_contains(state["split"], rest(word, f))))
        first = F.get(firsts, F.lit(0))
        return F.when(
            first.isNull(),
            F.struct(F.concat(state["kept"], F.array(word)).alias("kept"), state["split"].alias("split")),
        ).otherwise(F.struct(
            state["kept"].alias("kept"),
            F.array_except(state["split"], F.array(first, rest(word, first))).alias("split")))

    state = F.aggregate(joined, zero, step)
    return state["kept"], state["split"]


def unmatched_on_both_sides(left: Column, right: Column) -> Column:
    """After pairing each left word with its nearest close right word, both sides still hold a word."""
    zero = F.struct(right.alias("free"), F.lit(0).alias("alone"))

    def step(state: Column, word: Column) -> Column:
        scored = F.transform(state["free"], lambda o: F.struct(word_distance(word, o).alias("d"), o.alias("o")))
        best = F.array_min(F.filter(scored, lambda s: s["d"] <= fixed.SAME_WORD_DISTANCE))
        return F.when(
            best.isNull(), F.struct(state["free"].alias("free"), (state["alone"] + 1).alias("alone")),
        ).otherwise(F.struct(F.array_except(state["free"], F.array(best["o"])).alias("free"), state["alone"].alias("alone")))

    state = F.aggregate(left, zero, step)
    return (state["alone"] > 0) & (F.size(state["free"]) > 0)


def all_close(left: Column, right: Column) -> Column:
    return F.forall(left, lambda x: F.exists(right, lambda y: close_words(x, y)))


def abbreviated(name: Column) -> Column:
    return matches(name, fixed.ABBREVIATED_NAME)


