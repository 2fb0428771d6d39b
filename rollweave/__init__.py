"""Record cleaning, linkage, deduplication and validation as Spark plans."""

from .errors import ColumnClashError, FilterMismatchError, FurtherEducationError, MissingColumnError, PostcodeError, RollweaveError, RowIdentityError, YearGroupError, typed_errors
from .functions.postcode import format_postcode, valid_postcode
from .functions.school import academic_year_start, clean_year_group, dob_range, parse_year_group, reverse_date, year_group_from_date
from .functions.similarity import ratio, token_sort_ratio
from .functions.text import find_numbers, format_name, full_name, remove_diacritics, remove_numbers, remove_punctuation
from .log import cleaned, counted, disable_logging, enable_logging
from .operators.columns import snake_case, snake_case_columns
from .operators.duplicates import find_duplicates
from .operators.match import Match, exact_match, fuzzy_match, school_age_match, waterfall
from .operators.updates import get_contextual_updates, get_updates, with_updates
from .sources.files import excel_files, read_csv, read_excel, union_all

__all__ = [n for n in dir() if n[0] != "_" and n not in ("errors", "functions", "log", "operators", "plans", "sources")] + ["error_report"]


def __getattr__(name: str):
    if name == "error_report":  # its dependency is loaded when it is asked for
        from .operators.validation import error_report

        return error_report
    raise AttributeError(name)
