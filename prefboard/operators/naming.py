"""Model, language and subset names as they appear in reports and file keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefboard.functions import fixed


def relabel_model_type(df: DataFrame, column="model_type") -> DataFrame:
    return df.replace(fixed.MODEL_TYPE_LABELS, subset=[column])


def display_model(df: DataFrame, column="model") -> DataFrame:
    """Display names; names without one stay as they are."""
    return df.replace(fixed.MODEL_TITLES, subset=[column])


def display_subset(df: DataFrame, column="subset") -> DataFrame:
    return df.replace(fixed.SUBSET_TITLES, subset=[column])


def short_language(df: DataFrame, column="language") -> DataFrame:
    """`spa_Latn` -> `spa` -> `es`; languages without a label keep three letters."""
    return df.withColumn(column, F.split_part(F.col(column), F.lit("_"), F.lit(1))).replace(
        fixed.LANGUAGE_LABELS, subset=[column]
    )


def language_name(language: Column) -> Column:
    """Language name of a FLORES code, null for other codes."""
    pairs = [F.lit(x) for item in fixed.LANGUAGE_NAMES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), language)


def qualified_model(judges: Column) -> Column:
    """Result name of a run: provider-prefixed, or `PoLL/` and all ensemble names."""
    single = F.get(judges, 0)
    name = F.when(F.size(judges) > 1, F.concat(F.lit("PoLL/"), F.array_join(judges, "_")))
    for provider, models in fixed.PROVIDER_MODELS.items():
        name = name.when(single.isin(models), F.concat(F.lit(provider + "/"), single))
    return name.otherwise(single)


def prompt_family(model: Column) -> Column:
    """Prompt family of a model name, null for the default prompts."""
    family = F.when(F.lit(False), F.lit(""))
    for part, value in fixed.PROMPT_FAMILIES:
        family = family.when(F.contains(model, F.lit(part)), F.lit(value))
    return family


def prompt_family_of(model: str) -> str | None:
    """`prompt_family` of one name, without Spark."""
    return next((value for part, value in fixed.PROMPT_FAMILIES if part in model), None)


def result_key(model: Column) -> Column:
    """Model name as used in the names of result files."""
    return F.replace(model, F.lit("/"), F.lit("___"))


def translation_key(dataset: Column) -> Column:
    """Dataset name as used in the names of translated files."""
    return F.replace(dataset, F.lit("/"), F.lit("_"))


def imported_key(model: Column) -> Column:
    """Model name without its organisation, as used for imported results."""
    return F.split_part(model, F.lit("/"), F.lit(2))
