"""Scalar functions of the SQL surface as Spark SQL expressions.

NATIVE names mean in Spark what they mean here (under the session of `sparkforge.session`: no ANSI errors, so that bad
casts, zero divisors and out-of-range values are NULL, and the last of duplicate map keys wins). COMPOSED gives one text
for each number of arguments; {0}, {1}.. stand for them and {*} for all. UDFS have no such form and run as Arrow UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

NATIVE = frozenset(
    """
    upper lower ltrim rtrim trim reverse octet_length char_length replace regexp_like regexp_count coalesce uuid md5 sha1 sha2 crc32
    hex bit_length position locate instr split_part substring_index find_in_set translate url_encode soundex
    concat_ws space left right ascii
    ceil floor pi rand sin cos tan atan cbrt degrees radians atan2 log10 log2 bit_count bin conv
    if ifnull nullif assert_true isnull
    year month day dayofmonth hour minute second datediff dayofyear quarter dayofweek weekofyear weekday last_day
    timestampdiff timestampadd
    array_repeat array_distinct array_min array_max array_position array_remove array_append array_intersect arrays_overlap
    transform filter exists forall regexp_extract_all array_contains
    map_from_arrays map_keys map_values map_filter transform_keys transform_values named_struct struct
    count sum min avg any_value count_if bool_and bool_or bit_and bit_or bit_xor max_by min_by covar_pop covar_samp
    stddev_pop stddev_samp var_pop var_samp grouping grouping_id
    row_number rank dense_rank ntile cume_dist percent_rank lag lead first_value last_value nth_value
    """.split()
)

ALIASES = {
    "substr": "substring", "mid": "substring", "lcase": "lower", "ucase": "upper", "power": "pow", "ceiling": "ceil", "char": "chr",
    "character_length": "char_length", "get_json_object": "json_value", "timestamp": "to_datetime", "add_months": "date_add_months",
    "dround": "round", "format_datetime": "date_format", "approx_l2_distance": "l2_distance", "approx_cosine_similarity": "cosine_similarity",
    "cardinality": "array_length", "array_flatten": "flatten", "any_match": "exists", "all_match": "forall", "array_map": "transform",
    "countif": "count_if", "booland_agg": "bool_and", "boolor_agg": "bool_or", "std": "stddev_pop", "variance_pop": "var_pop",
    "variance_samp": "var_samp", "random": "rand", "adddate": "date_add", "subdate": "date_sub", "parse_datetime": "str_to_date",
    "str2date": "str_to_date", "array_generate": "array_generate", "string_agg": "group_concat", "parse_json": "parse_json",
    "ends_with": "ends_with", "starts_with": "starts_with", "element_at": "element_at", "map_size": "array_length",
}

_FINITE = "nullif(nullif(nanvl({0}, cast(NULL as double)), double('Infinity')), double('-Infinity'))"


def _finite(e: str) -> str:
    return _FINITE.replace("{0}", e)


def _strict(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"CASE WHEN {' AND '.join(f'({x}) IS NOT NULL' for x in a)} THEN {name}({', '.join(a)}) END"


def _quoted(pattern: str) -> str:
    """A regular expression that matches the text of `pattern` itself."""
    return f"concat('\\\\Q', replace({pattern}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"


def _add(unit: str, sign: str = "") -> str:
    return f"timestampadd({unit}, {sign}({{1}}), cast({{0}} as timestamp_ntz))"


#: name -> text, or {number of arguments: text}, or a function of the list of arguments.
COMPOSED: dict[str, object] = {
    # strings
    "length": "char_length({0})",
    "concat": lambda a: f"concat({', '.join(f'cast({x} as string)' for x in a)})",
    "substring": {2: "CASE WHEN ({1}) = 0 THEN '' ELSE substring({0}, {1}) END", 3: "CASE WHEN ({1}) = 0 THEN '' ELSE substring({0}, {1}, {2}) END"},
    "ltrim": {1: "ltrim({0})", 2: "trim(LEADING {1} FROM {0})"},
    "rtrim": {1: "rtrim({0})", 2: "trim(TRAILING {1} FROM {0})"},
    "trim": {1: "trim({0})", 2: "trim(BOTH {1} FROM {0})"},
    "ltrim_substring": lambda a: f"regexp_replace({a[0]}, concat('^(', {_quoted(a[1])}, ')+'), '')",
    "rtrim_substring": lambda a: f"regexp_replace({a[0]}, concat('(', {_quoted(a[1])}, ')+$'), '')",
    "trim_substring": lambda a: f"regexp_replace(regexp_replace({a[0]}, concat('^(', {_quoted(a[1])}, ')+'), ''), concat('(', {_quoted(a[1])}, ')+$'), '')",
    "regexp_replace": {3: "regexp_replace({0}, {1}, regexp_replace(regexp_replace({2}, '[$]', '\\\\\\\\$'), '\\\\\\\\(\\\\d)', '\\\\$$1'))"},
    "regexp_substr": {2: "nullif(regexp_extract({0}, concat('(', {1}, ')'), 1), '')", 3: "nullif(regexp_extract(substring({0}, {2}), concat('(', {1}, ')'), 1), '')", 4: "get(regexp_extract_all(substring({0}, {2}), concat('(', {1}, ')'), 1), ({3}) - 1)"},
    "regexp_instr": {2: "regexp_instr({0}, {1})"},
    "regexp_extract": {3: "regexp_extract({0}, concat('(', {1}, ')'), ({2}) + 1)"},
    "like": "(({0}) LIKE ({1}))",
    "md5sum": lambda a: f"md5(concat({', '.join(a)}))",
    "sha256": "sha2({0}, 256)",
    "unhex": "cast(unhex({0}) as string)",
    "to_base64": "base64(cast({0} as binary))",
    "from_base64": "cast(try_to_binary({0}, 'base64') as string)",
    "aes_encrypt": {2: "aes_encrypt({0}, {1}, 'ECB', 'PKCS')", 3: "aes_encrypt({0}, {1}, {2})"},
    "aes_decrypt": {2: "cast(try_aes_decrypt({0}, {1}, 'ECB', 'PKCS') as string)", 3: "cast(try_aes_decrypt({0}, {1}, {2}) as string)"},
    "lpad": {2: "CASE WHEN ({1}) >= 0 THEN lpad({0}, {1}) END", 3: "CASE WHEN ({1}) >= 0 THEN lpad({0}, {1}, {2}) END"},
    "rpad": {2: "CASE WHEN ({1}) >= 0 THEN rpad({0}, {1}) END", 3: "CASE WHEN ({1}) >= 0 THEN rpad({0}, {1}, {2}) END"},
    "repeat": "CASE WHEN octet_length({0}) * ({1}) <= 16777216 THEN repeat({0}, {1}) END",
    "append_trailing_char_if_absent": "CASE WHEN octet_length({1}) <> 1 THEN NULL WHEN ({0}) = '' OR endswith({0}, {1}) THEN ({0}) ELSE concat({0}, {1}) END",
    "ord": "cast(conv(hex(left({0}, 1)), 16, 10) as int)",
    "strpos": {2: "instr({0}, {1})", 3: "CASE WHEN size(split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)) > ({2}) THEN char_length(array_join(slice(split({0}, concat('\\\\Q', {1}, '\\\\E'), -1), 1, {2}), {1})) + 1 ELSE 0 END"},
    "starts_with": "startswith({0}, {1})",
    "ends_with": "endswith({0}, {1})",
    "null_or_empty": "(({0}) IS NULL OR char_length(cast({0} as string)) = 0)",
    "strcmp": "CASE WHEN ({0}) < ({1}) THEN -1 WHEN ({0}) > ({1}) THEN 1 WHEN ({0}) = ({1}) THEN 0 END",
    "field": lambda a: f"coalesce(array_position(array({', '.join(a[1:])}), {a[0]}), 0)",
    "initcap": "regexp_replace(initcap(regexp_replace({0}, '([^\\\\p{L}\\\\p{N}])', '$1\\u0001 ')), '\\u0001 ', '')",
    "chr": "chr({0})",
    "elt": lambda a: f"get(array({', '.join(a[1:])}), ({a[0]}) - 1)",
    "make_set": lambda a: "concat_ws(',', " + ", ".join(f"CASE WHEN shiftright({a[0]}, {i}) & 1 = 1 THEN {x} END" for i, x in enumerate(a[1:])) + ")",
    "insert": "CASE WHEN ({1}) BETWEEN 1 AND char_length({0}) THEN overlay({0} PLACING {3} FROM {1} FOR {2}) ELSE ({0}) END",
    "quote": "CASE WHEN ({0}) IS NULL THEN 'NULL' ELSE concat(\"'\", replace(replace({0}, '\\\\', '\\\\\\\\'), \"'\", \"\\\\'\"), \"'\") END",
    "to_binary": {1: "cast(try_to_binary({0}, 'utf-8') as string)", 2: "coalesce(cast(try_to_binary({0}, CASE {1} WHEN 'encode64' THEN 'base64' WHEN 'utf8' THEN 'utf-8' ELSE {1} END) as string), '')"},
    "from_binary": {1: "hex(cast({0} as binary))", 2: "CASE {1} WHEN 'encode64' THEN base64(cast({0} as binary)) WHEN 'utf8' THEN cast({0} as string) ELSE hex(cast({0} as binary)) END"},
    "format_bytes": lambda a: f"CASE WHEN ({a[0]}) < 0 THEN NULL WHEN ({a[0]}) < 1024 THEN concat({a[0]}, ' B') " + " ".join(f"WHEN ({a[0]}) < power(1024, {i + 2}) THEN concat(format_number(({a[0]}) / power(1024, {i + 1}), 2), ' {u}')" for i, u in enumerate(("KB", "MB", "GB", "TB", "PB"))) + f" ELSE concat(format_number(({a[0]}) / power(1024, 6), 2), ' EB') END",
    "bar": "repeat('▓', cast(floor((({0}) - ({1})) / (({2}) - ({1})) * ({3})) as int))",
    "equiwidth_bucket": "CASE WHEN ({0}) < ({1}) THEN 0 WHEN ({0}) > ({2}) THEN ({3}) + 1 ELSE least(cast(floor((({0}) - ({1})) / ceil((({2}) - ({1}) + 1) / ({3}))) as bigint), ({3}) - 1) + 1 END",
    "__iceberg_transform_truncate": "(({0}) - pmod({0}, {1}))",
    "url_decode": "coalesce(try_url_decode({0}), {0})",
    "url_extract_host": "try_parse_url({0}, 'HOST')",
    "url_extract_parameter": "try_url_decode(try_parse_url({0}, 'QUERY', {1}))",
    "inet_aton": "CASE WHEN ({0}) RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' AND forall(split({0}, '[.]'), p -> cast(p as int) < 256) THEN aggregate(split({0}, '[.]'), 0L, (acc, p) -> acc * 256 + cast(p as bigint)) END",
    "inet_ntoa": "CASE WHEN ({0}) BETWEEN 0 AND 4294967295 THEN concat_ws('.', shiftright(cast({0} as bigint), 24) & 255, shiftright(cast({0} as bigint), 16) & 255, shiftright(cast({0} as bigint), 8) & 255, cast({0} as bigint) & 255) END",
    "is_ipv4": "cast(coalesce(({0}) RLIKE '^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}$', false) as int)",
    # numbers
    "abs": "abs({0})",
    "round": {1: "round({0})", 2: "round({0}, {1})"},
    "sign": "cast(sign({0}) as int)",
    "mod": "try_mod({0}, {1})",
    "pmod": "CASE WHEN ({1}) <> 0 THEN pmod({0}, {1}) END",
    "fmod": "CASE WHEN ({1}) <> 0 THEN cast({0} as double) % cast({1} as double) END",
    "add": "(({0}) + ({1}))",
    "sub": "(({0}) - ({1}))",
    "mul": "(({0}) * ({1}))",
    "div": "try_divide({0}, {1})",
    "intdiv": "CASE WHEN ({1}) <> 0 THEN ({0}) div ({1}) END",
    "pow": _finite("power({0}, {1})"),
    "sqrt": _finite("sqrt({0})"),
    "exp": _finite("exp({0})"),
    "ln": "ln({0})",
    "log": {1: "ln({0})", 2: "log({0}, {1})"},
    "asin": _finite("asin({0})"),
    "acos": _finite("acos({0})"),
    "cot": _finite("cot({0})"),
    "greatest": _strict("greatest"),
    "least": _strict("least"),
    "square": "(({0}) * ({0}))",
    "bitand": "(({0}) & ({1}))",
    "bitor": "(({0}) | ({1}))",
    "bitxor": "(({0}) ^ ({1}))",
    "bitnot": "(~({0}))",
    "bit_shift_left": "shiftleft({0}, {1})",
    "bit_shift_right": "shiftright({0}, {1})",
    "truncate": "(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))",
    "interval": lambda a: f"CASE WHEN ({a[0]}) IS NULL THEN -1 ELSE size(filter(array({', '.join(a[1:])}), z -> z <= ({a[0]}))) END",
    "format": "format_number({0}, {1})",
    # conversions
    "to_int": "cast({0} as int)", "to_bigint": "cast({0} as bigint)", "to_smallint": "cast({0} as smallint)", "to_tinyint": "cast({0} as tinyint)",
    "to_largeint": "cast({0} as decimal(38,0))", "to_double": "cast({0} as double)", "to_float": "cast({0} as float)", "to_boolean": "cast({0} as boolean)",
    "to_date": {1: "cast({0} as date)", 2: "cast(try_to_timestamp({0}, {1}) as date)"}, "to_datetime": "cast({0} as timestamp_ntz)",
    "to_string": "cast({0} as string)", "positive": "({0})", "date": "cast({0} as date)",
    # JSON
    "json_extract": "get_json_object({0}, {1})", "json_value": "get_json_object({0}, {1})", "get_json_string": "get_json_object({0}, {1})",
    "json_unquote": "coalesce(get_json_object({0}, '$'), {0})",
    "json_quote": "regexp_extract(to_json(named_struct('v', {0})), '(?s)^[{{]\"v\":(.*)[}}]$', 1)",
    "json_valid": "(try_parse_json({0}) IS NOT NULL)",
    "json_type": "CASE WHEN try_parse_json({0}) IS NULL THEN NULL WHEN is_variant_null(try_parse_json({0})) THEN 'NULL' WHEN schema_of_variant(try_parse_json({0})) LIKE 'OBJECT%' THEN 'OBJECT' WHEN schema_of_variant(try_parse_json({0})) LIKE 'ARRAY%' THEN 'ARRAY' WHEN schema_of_variant(try_parse_json({0})) = 'BIGINT' THEN 'INTEGER' WHEN schema_of_variant(try_parse_json({0})) = 'BOOLEAN' THEN 'BOOLEAN' WHEN schema_of_variant(try_parse_json({0})) = 'STRING' THEN 'STRING' ELSE 'DOUBLE' END",
    "json_length": {1: "CASE WHEN try_parse_json({0}) IS NULL THEN NULL ELSE coalesce(json_array_length({0}), size(json_object_keys({0})), 1) END", 2: "coalesce(json_array_length(get_json_object({0}, {1})), size(json_object_keys(get_json_object({0}, {1}))), if(get_json_object({0}, {1}) is null, NULL, 1))"},
    "json_keys": "to_json(json_object_keys({0}))",
    "parse_json": "to_json(try_parse_json({0}))",
    "get_json_int": "try_variant_get(try_parse_json({0}), {1}, 'bigint')", "get_json_double": "try_variant_get(try_parse_json({0}), {1}, 'double')", "get_json_bool": "try_variant_get(try_parse_json({0}), {1}, 'boolean')",
    "json_query": "to_json(try_variant_get(try_parse_json({0}), {1}, 'variant'))",
    "json_exists": "(try_variant_get(try_parse_json({0}), {1}, 'variant') IS NOT NULL)",
    "to_json": "to_json({0})",
    "json_array": lambda a: f"to_json(array({', '.join(a)}))",
    "json_object": lambda a: f"to_json(named_struct({', '.join(a)}))",
    "json_arrayagg": "to_json(collect_list({0}))",
    "json_objectagg": "to_json(map_from_entries(collect_list(struct({0}, {1}))))",
    # dates
    "makedate": "CASE WHEN ({1}) > 0 THEN date_add(make_date({0}, 1, 1), ({1}) - 1) END",
    "time": "date_format(cast({0} as timestamp_ntz), 'HH:mm:ss')",
    "time_to_sec": "(hour(cast({0} as timestamp_ntz)) * 3600 + minute(cast({0} as timestamp_ntz)) * 60 + second(cast({0} as timestamp_ntz)))",
    "sec_to_time": "concat(if(({0}) < 0, '-', ''), lpad(cast(abs({0}) div 3600 as string), 2, '0'), ':', lpad(cast(abs({0}) div 60 % 60 as string), 2, '0'), ':', lpad(cast(abs({0}) % 60 as string), 2, '0'))",
    "maketime": "concat(lpad(cast({0} as string), 2, '0'), ':', lpad(cast({1} as string), 2, '0'), ':', lpad(cast({2} as string), 2, '0'))",
    "to_days": "cast(unix_date(cast({0} as date)) + 719528 as bigint)",
    "to_seconds": "((unix_date(cast({0} as date)) + 719528) * 86400L + hour(cast({0} as timestamp_ntz)) * 3600 + minute(cast({0} as timestamp_ntz)) * 60 + second(cast({0} as timestamp_ntz)))",
    "from_days": "date_from_unix_date(cast(({0}) - 719528 as int))",
    "period_add": "(((({0}) div 100) * 12 + ({0}) % 100 - 1 + ({1})) div 12 * 100 + ((({0}) div 100) * 12 + ({0}) % 100 - 1 + ({1})) % 12 + 1)",
    "period_diff": "((({0}) div 100) * 12 + ({0}) % 100 - (({1}) div 100) * 12 - ({1}) % 100)",
    "convert_tz": "convert_timezone({1}, {2}, {0})",
    "date_add": _add("DAY"), "date_sub": _add("DAY", "-"), "date_add_weeks": _add("WEEK"), "date_add_months": _add("MONTH"), "date_add_quarters": _add("QUARTER"),
    "date_add_years": _add("YEAR"), "date_add_hours": _add("HOUR"), "date_add_minutes": _add("MINUTE"), "date_add_seconds": _add("SECOND"),
    "date_add_millis": _add("MILLISECOND"), "date_add_micros": _add("MICROSECOND"),
    "unix_timestamp": {0: "unix_timestamp()", 1: "unix_seconds(cast({0} as timestamp))"},
    "from_unixtime": {1: "cast(timestamp_seconds({0}) as timestamp_ntz)"},
    "to_datetime_ntz": {1: "cast(timestamp_seconds({0}) as timestamp_ntz)", 2: "CASE {1} WHEN 3 THEN cast(timestamp_millis({0}) as timestamp_ntz) WHEN 6 THEN cast(timestamp_micros({0}) as timestamp_ntz) ELSE cast(timestamp_seconds({0}) as timestamp_ntz) END"},
    "__to_datetime": {1: "cast(timestamp_seconds({0}) as timestamp_ntz)"},
    "years_diff": "cast(timestampdiff(YEAR, {1}, {0}) as bigint)", "months_diff": "timestampdiff(MONTH, {1}, {0})", "weeks_diff": "timestampdiff(WEEK, {1}, {0})", "days_diff": "timestampdiff(DAY, {1}, {0})",
    "hours_diff": "timestampdiff(HOUR, {1}, {0})", "minutes_diff": "timestampdiff(MINUTE, {1}, {0})", "seconds_diff": "timestampdiff(SECOND, {1}, {0})", "milliseconds_diff": "timestampdiff(MILLISECOND, {1}, {0})",
    "date_diff": lambda a: f"timestampdiff({a[0].strip().strip(chr(39)).upper()}, {a[2]}, {a[1]})",
    "dayname": "date_format({0}, 'EEEE')", "monthname": "date_format({0}, 'MMMM')", "week_iso": "weekofyear({0})", "dayofweek_iso": "(weekday({0}) + 1)",
    "microsecond": "cast(date_format({0}, 'SSSSSS') as int)",
    "yearweek": {1: "(year(date_sub({0}, dayofweek({0}) - 1)) * 100 + cast(ceil(dayofyear(date_sub({0}, dayofweek({0}) - 1)) / 7) as int))"},
    "week": {1: "cast(floor((dayofyear({0}) + 6 - (dayofweek({0}) - 1)) / 7) as int)"},
    "next_day": "next_day({0}, {1})", "previous_day": "next_day(date_sub({0}, 8), {1})",
    "to_iso8601": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "jodatime_format": "date_format({0}, {1})", "str_to_jodatime": "cast(try_to_timestamp({0}, {1}) as timestamp_ntz)",
    "date_trunc": "cast(date_trunc({0}, {1}) as timestamp_ntz)",
    "time_slice": lambda a: _slice(a), "date_slice": lambda a: f"cast({_slice(a)} as date)",
    "extract_year_month": "(year({0}) * 100 + month({0}))", "extract_day_hour": "(day({0}) * 100 + hour({0}))", "extract_day_minute": "(day({0}) * 10000 + hour({0}) * 100 + minute({0}))",
    "extract_day_second": "(day({0}) * 1000000 + hour({0}) * 10000 + minute({0}) * 100 + second({0}))", "extract_hour_minute": "(hour({0}) * 100 + minute({0}))",
    "extract_hour_second": "(hour({0}) * 10000 + minute({0}) * 100 + second({0}))", "extract_minute_second": "(minute({0}) * 100 + second({0}))",
    # arrays, vectors
    "array_value": lambda a: f"array({', '.join(a)})",
    "split": lambda a: f"split({a[0]}, {_quoted(a[1])}, -1)",
    "array_generate": {1: "CASE WHEN ({0}) >= 1 THEN sequence(1, {0}) ELSE array() END", 2: "sequence({0}, {1})", 3: "CASE WHEN ({2}) <> 0 AND sign({2}) * (({1}) - ({0})) >= 0 THEN sequence({0}, {1}, {2}) ELSE array() END"},
    "array_length": "size({0})", "array_sort": {1: "sort_array({0})", 2: "array_sort({0}, {1})"}, "array_reverse": "reverse({0})",
    "array_sum": "CASE WHEN exists({0}, z -> z IS NOT NULL) THEN aggregate({0}, 0D, (acc, z) -> acc + coalesce(z, 0)) END",
    "array_avg": "try_divide(aggregate({0}, 0D, (acc, z) -> acc + coalesce(z, 0)), size(filter({0}, z -> z IS NOT NULL)))",
    "array_difference": "transform({0}, (z, i) -> IF(i = 0, 0, z - get({0}, i - 1)))",
    "flatten": "flatten({0})", "element_at": "try_element_at({0}, {1})", "array_slice": {2: "slice({0}, {1}, greatest(size({0}), 1))", 3: "slice({0}, {1}, {2})"},
    "array_join": {2: "array_join(transform({0}, z -> cast(z as string)), {1})", 3: "array_join(transform({0}, z -> cast(z as string)), {1}, {2})"},
    "array_contains": "coalesce(exists({0}, z -> z <=> ({1})), ({0}) IS NOT NULL AND false)",
    "array_concat": lambda a: f"concat({', '.join(a)})",
    "array_contains_all": "(size(array_except({1}, {0})) = 0)",
    "array_contains_seq": "(size({1}) = 0 OR exists(sequence(1, greatest(size({0}), 1)), i -> slice({0}, i, greatest(size({1}), 1)) = ({1})))",
    "array_order": "CASE WHEN ({0}) < ({1}) THEN -1 WHEN ({0}) = ({1}) THEN 0 ELSE 1 END",
    "array_filter": lambda a: f"filter({a[1]}, {a[0]})" if "->" in a[0] else (f"filter({a[0]}, {a[1]})" if "->" in a[1] else f"transform(filter(arrays_zip({a[0]}, {a[1]}), z -> z['1']), z -> z['0'])"),
    "array_sortby": lambda a: f"transform(array_sort(transform({a[1]}, {a[0].split('->')[0]} -> struct({a[0].split('->', 1)[1]} AS k, {a[0].split('->')[0]} AS v))), p -> p.v)" if "->" in a[0] else f"transform(array_sort(arrays_zip({a[1]} AS k, {a[0]} AS v)), p -> p.v)",
    "cosine_similarity": "aggregate(zip_with({0}, {1}, (p, q) -> cast(p as double) * q), 0D, (acc, z) -> acc + z) / nullif(sqrt(aggregate({0}, 0D, (c, z) -> c + cast(z as double) * z)) * sqrt(aggregate({1}, 0D, (c, z) -> c + cast(z as double) * z)), 0)",
    "cosine_similarity_norm": "aggregate(zip_with({0}, {1}, (p, q) -> cast(p as double) * q), 0D, (acc, z) -> acc + z)",
    "l2_distance": "aggregate(zip_with({0}, {1}, (p, q) -> (cast(p as double) - q) * (cast(p as double) - q)), 0D, (acc, z) -> acc + z)",
    # maps
    "row": lambda a: "named_struct(" + ", ".join(f"'col{i + 1}', {x}" for i, x in enumerate(a)) + ")",
    "map": lambda a: f"map_from_arrays(array({', '.join(a[::2])}), array({', '.join(a[1::2])}))" if a else "map()",
    "map_concat": lambda a: f"map_concat({', '.join(f'coalesce({x}, map())' for x in a)})", "distinct_map_keys": "({0})", "str_to_map": {3: "str_to_map({0}, {1}, {2})", 1: "str_to_map({0})"},
    "map_apply": lambda a: f"map_from_entries(transform(map_entries({a[1]}), e -> {a[0]}))",
    # bitmaps: sorted distinct arrays of BIGINT
    "to_bitmap": "array(cast({0} as bigint))", "bitmap_empty": "cast(array() as array<bigint>)",
    "bitmap_from_string": "array_sort(array_distinct(transform(split({0}, ','), z -> cast(z as bigint))))", "bitmap_to_string": "array_join(transform({0}, z -> cast(z as string)), ',')",
    "bitmap_count": "coalesce(size({0}), 0)", "bitmap_min": "array_min({0})", "bitmap_max": "array_max({0})", "bitmap_contains": "array_contains({0}, cast({1} as bigint))", "bitmap_has_any": "arrays_overlap({0}, {1})",
    "bitmap_or": "array_sort(array_union({0}, {1}))", "bitmap_and": "array_sort(array_intersect({0}, {1}))", "bitmap_xor": "array_sort(array_union(array_except({0}, {1}), array_except({1}, {0})))",
    "bitmap_andnot": "array_except({0}, {1})", "bitmap_remove": "array_remove({0}, cast({1} as bigint))", "bitmap_to_array": "({0})", "array_to_bitmap": "array_sort(array_distinct(transform({0}, z -> cast(z as bigint))))",
    "bitmap_subset_in_range": "filter({0}, z -> z >= ({1}) AND z < ({2}))", "bitmap_subset_limit": "slice(filter({0}, z -> z >= ({1})), 1, {2})", "sub_bitmap": "slice({0}, ({1}) + 1, {2})",
    # aggregates
    "count_distinct": lambda a: f"count(DISTINCT {', '.join(a)})", "approx_count_distinct": "count(DISTINCT {0})", "ndv": "count(DISTINCT {0})", "multi_distinct_count": "count(DISTINCT {0})", "approx_count_distinct_hll_sketch": "count(DISTINCT {0})", "bitmap_union_int": "count(DISTINCT {0})",
    "multi_distinct_sum": "sum(DISTINCT {0})", "median": "percentile({0}, 0.5)", "percentile_cont": "percentile({0}, {1})", "percentile": "percentile({0}, {1})",
    "percentile_disc": "get(array_sort(collect_list({0})), cast(greatest(ceil(({1}) * count({0})), 1) as int) - 1)", "percentile_disc_lc": "get(array_sort(collect_list({0})), cast(greatest(ceil(({1}) * count({0})), 1) as int) - 1)",
    "percentile_approx_weighted": lambda a: _weighted(*a[:3]),
    "percentile_approx": lambda a: _percentile(*a[:2]),
    "corr": "nanvl(corr({0}, {1}), NULL)", "variance": "var_pop({0})", "stddev": "stddev_pop({0})",
    # A NaN never is the largest; the test of the type is folded before the query runs.
    "max": "max(if(typeof({0}) IN ('double', 'float') AND cast({0} as string) = 'NaN', NULL, {0}))",
    "first": "first({0}, true)", "last": "last({0}, true)",
    "approx_top_k": lambda a: _top(a[0], a[1] if len(a) > 1 else "5"),
    "bitmap_agg": "array_sort(collect_set(cast({0} as bigint)))", "bitmap_union": "array_sort(array_distinct(flatten(collect_list({0}))))", "bitmap_union_count": "size(array_distinct(flatten(collect_list({0}))))",
    "bitmap_intersect": "aggregate(collect_list({0}), cast(NULL as array<bigint>), (acc, z) -> coalesce(array_intersect(acc, z), z))",
    "array_agg": "transform(collect_list(struct({0} AS v)), z -> z.v)", "array_agg_distinct": "array_sort(collect_set({0}))", "array_unique_agg": "array_distinct(flatten(collect_list({0})))",
    "map_agg": "map_from_entries(collect_list(CASE WHEN ({0}) IS NOT NULL THEN struct({0}, {1}) END))",
    # session
    "utc_time": {0: "date_format(localtimestamp(), 'HH:mm:ss')"}, "charset": "if(typeof({0}) = 'binary', 'binary', 'utf8mb4')", "collation": "if(typeof({0}) = 'binary', 'binary', 'utf8mb4_bin')", "benchmark": "cast(0 as int)",
    "get_format": lambda a: f"'{DATE_FORMATS[a[0].strip().lower()][a[1].strip().strip(chr(39)).lower()]}'",
    "typeof": "typeof({0})", "database": {0: "current_database()"}, "schema": {0: "current_database()"}, "connection_id": {0: "cast(1 as bigint)"},
    "curdate": {0: "current_date()"}, "utc_date": {0: "current_date()"}, "sysdate": {0: "localtimestamp()"}, "utc_timestamp": {0: "localtimestamp()"},
}

for _unit in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"):
    COMPOSED[f"{_unit.lower()}s_add"] = _add(_unit)
    COMPOSED[f"{_unit.lower()}s_sub"] = _add(_unit, "-")


def _slice(a: list[str]) -> str:
    """Start (or end) of the slice of n units that holds a time; slices are counted from 0001-01-01, a Monday."""
    unit = a[2].strip().strip("'").upper()
    end = len(a) > 3 and a[3].strip().strip("'").lower() == "ceil"
    x, origin = f"cast({a[0]} as timestamp_ntz)", "timestamp_ntz'0001-01-01 00:00:00'"
    return f"timestampadd({unit}, cast(floor(timestampdiff({unit}, {origin}, {x}) / ({a[1]})) as int) * ({a[1]}){f' + ({a[1]})' if end else ''}, {origin})"


def _top(x: str, k: str) -> str:
    """The group is sorted once; the places where a value begins give each value's number of rows."""
    starts = "filter(sequence(0, size(l)), i -> i < size(l) AND (i = 0 OR NOT get(l, i) <=> get(l, i - 1)))"
    counted = "transform(s, (i, j) -> named_struct('c', i - coalesce(get(s, j + 1), size(l)), 'n', if(get(l, i).v IS NULL, 0, 1), 'v', get(l, i).v))"
    rows = f"transform(slice(array_sort(transform(array({starts}), s -> {counted})[0]), 1, {k}), r -> named_struct('item', r.v, 'count', cast(-r.c as bigint)))"
    return f"transform(array(sort_array(collect_list(struct({x} AS v)))), l -> {rows})[0]"


def _percentile(x: str, p: str) -> str:
    """Interpolates at p * n - 1/2."""
    at = f"greatest(0D, least(size(v) - 1D, ({p}) * size(v) - 0.5D))"
    return f"transform(array(array_sort(collect_list(cast({x} as double)))), v -> get(v, int(floor({at}))) + ({at} - floor({at})) * (get(v, int(ceil({at}))) - get(v, int(floor({at})))))[0]"


def _weighted(x: str, w: str, p: str) -> str:
    """Values are centroids of their whole weights; linear between centres at p of the total, one pass over the sorted group."""
    rows = f"array_sort(filter(collect_list(struct(cast({x} as double) AS v, cast({w} as bigint) AS w)), z -> z.v IS NOT NULL AND NOT isnan(z.v) AND z.w >= 1))"
    none = "cast(NULL as double)"
    at = "q.s + z.w / 2D"
    found = f"coalesce(q.a, CASE WHEN {at} >= t THEN CASE WHEN q.c IS NULL THEN z.v ELSE q.v + (t - q.c) / ({at} - q.c) * (z.v - q.v) END END)"
    step = f"named_struct('s', q.s + z.w, 'c', {at}, 'v', z.v, 'a', {found})"
    scan = f"aggregate(l, named_struct('s', 0D, 'c', {none}, 'v', {none}, 'a', {none}), (q, z) -> {step}, q -> coalesce(q.a, q.v))"
    return f"transform(array({rows}), l -> transform(array(({p}) * aggregate(l, 0D, (b, y) -> b + y.w)), t -> {scan})[0])[0]"


#: Specifiers of date_format and str_to_date as pattern letters of Spark.
DATE_SPECIFIERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%"}
TERA = {"yyyy": "yyyy", "mm": "MM", "dd": "dd", "hh24": "HH", "hh": "hh", "mi": "mm", "ss": "ss", "am": "a", "pm": "a"}


def date_pattern(literal: str) -> str:
    """'%Y-%m' -> 'yyyy-MM'; letters between specifiers are quoted."""
    s = literal.strip()[1:-1]
    parts = re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", s)
    return "'" + "".join(DATE_SPECIFIERS.get(p, p[1:]) if p[0] == "%" else (f"''{p}''" if p[0].isalpha() else p) for p in parts) + "'"


def _tera(literal: str) -> str:
    s = literal.strip()[1:-1].lower()
    return "'" + re.sub("|".join(sorted(TERA, key=len, reverse=True)), lambda m: TERA[m[0]], s) + "'"


def _has_specifier(a: list[str]) -> bool:
    return a[1].strip().startswith("'") and "%" in a[1]


# GET_FORMAT by kind and standard.
DATE_FORMATS = {
    "date": {"usa": "%m.%d.%Y", "jis": "%Y-%m-%d", "iso": "%Y-%m-%d", "eur": "%d.%m.%Y", "internal": "%Y%m%d"},
    "datetime": {"usa": "%Y-%m-%d %H.%i.%s", "jis": "%Y-%m-%d %H:%i:%s", "iso": "%Y-%m-%d %H:%i:%s", "eur": "%Y-%m-%d %H.%i.%s", "internal": "%Y%m%d%H%i%s"},
    "time": {"usa": "%h:%i:%s %p", "jis": "%H:%i:%s", "iso": "%H:%i:%s", "eur": "%H.%i.%s", "internal": "%H%i%s"},
}

COMPOSED["date_format"] = lambda a: f"date_format({a[0]}, {date_pattern(a[1]) if _has_specifier(a) else a[1]})"
COMPOSED["str_to_date"] = lambda a: f"cast(try_to_timestamp({a[0]}, {date_pattern(a[1]) if _has_specifier(a) else a[1]}) as {'timestamp_ntz' if re.search('%[HhIklisSfTr]', a[1]) else 'date'})"
COMPOSED["str_to_time"] = lambda a: f"date_format(try_to_timestamp({a[0]}, {date_pattern(a[1])}), 'HH:mm:ss')"
COMPOSED["to_tera_date"] = lambda a: f"cast(try_to_timestamp({a[0]}, {_tera(a[1])}) as date)"
COMPOSED["to_tera_timestamp"] = lambda a: f"cast(try_to_timestamp({a[0]}, {_tera(a[1])}) as timestamp_ntz)"


#: Calls with a syntax of their own, which the front end rewrites.
OWN_SYNTAX = frozenset("group_concat cast convert extract".split())


def known(name: str) -> bool:
    from .udfs import UDFS

    name = ALIASES.get(name.lower(), name.lower())
    return name in COMPOSED or name in NATIVE or name in UDFS or name in OWN_SYNTAX


def rewrite(name: str, args: list[str], dialect: str = "neutral") -> str | None:
    """The Spark text of a call, or None where the call is Spark's own."""
    name = ALIASES.get(name.lower(), name.lower())
    if name == "log" and len(args) == 1 and dialect != "mysql":
        return f"log10({args[0]})"
    if name in ("stddev", "variance") and dialect == "postgres":
        return f"{'stddev_samp' if name == 'stddev' else 'var_samp'}({args[0]})"
    form = COMPOSED.get(name)
    if form is None:
        from .udfs import UDFS

        return f"sf_{name}({', '.join(args)})" if name in UDFS else (f"{name}({', '.join(args)})" if name in NATIVE else None)
    if callable(form):
        return form(args)
    if isinstance(form, dict):
        if len(args) not in form:
            return None
        form = form[len(args)]
    out = form.replace("{*}", ", ".join(args)).replace("{{", "\x00").replace("}}", "\x01")
    out = re.sub(r"\{(\d)\}", lambda m: args[int(m[1])] if int(m[1]) < len(args) else "NULL", out)
    return out.replace("\x00", "{").replace("\x01", "}")
