"""DuckDB reference SQL for each registered query (the correctness oracle).

Written independently of the Spark plans: per-trip window functions and plain
GROUP BYs over the driver's tables, with the same adapter arithmetic.
Report columns are rounded with ``floor(x * 10^d + 0.5) / 10^d`` on both sides.
"""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


TRIPS = """
trips as (
  select event_id as trip_id,
         ts as tpep_pickup_datetime,
         ts + to_seconds(cast(event_id * 37 % 25000 as bigint)) as tpep_dropoff_datetime,
         case when event_id % 13 = 0 then null else cast(event_id % 11 as integer) end as passenger_count,
         value / 5.0::double as trip_distance,
         cast(user_id % 27 + 1 as integer) as "PULocationID",
         cast(event_id % 25 + 1 as integer) as "DOLocationID",
         2.5::double + value / 3.0::double as fare_amount,
         value - 1.0::double as total_amount
  from events
)"""

CLEAN = """
clean as (
  select * from trips
  where tpep_pickup_datetime is not null and tpep_dropoff_datetime is not null
    and tpep_pickup_datetime >= timestamp '2024-01-01 00:00:00'
    and tpep_pickup_datetime < timestamp '2025-01-01 00:00:00'
    and trip_distance between 0.1 and 200.0
    and fare_amount between 1.0 and 5000.0
    and (passenger_count is null or passenger_count between 1 and 9)
    and total_amount > 0
)"""

TEMPORAL = """
temporal0 as (
  select *,
         cast(tpep_pickup_datetime as date) as pickup_date,
         cast(hour(tpep_pickup_datetime) as integer) as hour,
         cast(dayofweek(tpep_pickup_datetime) + 1 as integer) as day_of_week,
         cast(day(tpep_pickup_datetime) as integer) as day_of_month,
         cast(month(tpep_pickup_datetime) as integer) as month,
         case when dayofweek(tpep_pickup_datetime) in (0, 6) then 1 else 0 end as is_weekend,
         case when hour(tpep_pickup_datetime) between 7 and 9
                or hour(tpep_pickup_datetime) between 16 and 19 then 1 else 0 end as is_rush_hour,
         round((floor(epoch(tpep_dropoff_datetime)) - floor(epoch(tpep_pickup_datetime))) / 60.0::double, 2)
           as trip_duration_minutes,
         cast(floor(epoch(tpep_pickup_datetime)) as bigint) as pickup_unix_ts
  from clean
),
temporal as (
  select * from temporal0 where trip_duration_minutes > 0.5 and trip_duration_minutes < 360
)"""

ZONES = """
zones as (
  select cast(n_nationkey + 1 as integer) as "LocationID", r_name as "Borough",
         n_name as "Zone", 'Boro Zone' as service_zone
  from nation left join region on n_regionkey = r_regionkey
)"""

DEMAND = """
demand as (
  select *,
    count(*) over (partition by "PULocationID" order by pickup_unix_ts
                   range between 900 preceding and current row) as demand_15min,
    count(*) over (partition by "PULocationID" order by pickup_unix_ts
                   range between 1800 preceding and current row) as demand_30min,
    count(*) over (partition by "PULocationID" order by pickup_unix_ts
                   range between 3600 preceding and current row) as demand_60min
  from temporal
)"""

SUPPLY = """
supply as (
  select "PULocationID", hour, day_of_week,
         avg(demand_60min) as supply_baseline,
         stddev_samp(demand_60min) as supply_stddev,
         count(*) as sample_count
  from demand group by 1, 2, 3
)"""

SURGED = """
surged0 as (
  select d.*,
         case when s.supply_baseline is null or s.supply_baseline = 0 then 1.0::double
              else s.supply_baseline end as supply_baseline,
         s.supply_stddev, s.sample_count
  from demand d left join supply s
    on d."PULocationID" = s."PULocationID" and d.hour = s.hour and d.day_of_week = s.day_of_week
),
surged as (
  select *,
         greatest(1.0::double, least(5.0::double, demand_60min / supply_baseline)) as surge_multiplier,
         case when supply_stddev is not null and supply_stddev > 0
              then (demand_60min - supply_baseline) / supply_stddev else 0.0::double end as demand_zscore
  from surged0
)"""


def with_(*ctes: str) -> str:
    return "with " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


BASE = with_(TRIPS, CLEAN, TEMPORAL)
FEATURE_BASE = with_(TRIPS, CLEAN, TEMPORAL, DEMAND, SUPPLY, SURGED)

RAW_PRESENT = (
    'tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, trip_distance, '
    '"PULocationID", "DOLocationID", fare_amount, total_amount'
)

SQL: dict[str, str] = {}

SQL["scan_prune"] = with_(TRIPS) + f"select {RAW_PRESENT} from trips"

SQL["quality_filter"] = with_(TRIPS, CLEAN) + "select * from clean"

SQL["temporal_features"] = BASE + """
select trip_id, pickup_date, hour, day_of_week, day_of_month, month, is_weekend,
       is_rush_hour, trip_duration_minutes
from temporal"""

SQL["zone_scan"] = with_(ZONES) + "select * from zones"

SQL["zone_join"] = with_(TRIPS, CLEAN, TEMPORAL, ZONES) + """
select t.trip_id, t."PULocationID", t."DOLocationID",
       pz."Borough" as pickup_borough, pz."Zone" as pickup_zone, pz.service_zone as pickup_service_zone,
       dz."Borough" as dropoff_borough, dz."Zone" as dropoff_zone, dz.service_zone as dropoff_service_zone
from temporal t
left join zones pz on t."PULocationID" = pz."LocationID"
left join zones dz on t."DOLocationID" = dz."LocationID"
"""

SQL["zone_placeholder"] = with_(TRIPS, CLEAN) + """
select trip_id, 'Unknown' as pickup_borough, 'Zone_' || cast("PULocationID" as varchar) as pickup_zone,
       'Unknown' as pickup_service_zone, 'Unknown' as dropoff_borough,
       'Zone_' || cast("DOLocationID" as varchar) as dropoff_zone, 'Unknown' as dropoff_service_zone
from clean"""

SQL["rolling_demand"] = with_(TRIPS, CLEAN, TEMPORAL, DEMAND) + """
select trip_id, pickup_unix_ts, demand_15min, demand_30min, demand_60min from demand"""

SQL["supply_baseline"] = with_(TRIPS, CLEAN, TEMPORAL, DEMAND, SUPPLY) + f"""
select "PULocationID", hour, day_of_week,
       {r('supply_baseline')} as supply_baseline,
       {r('supply_stddev')} as supply_stddev,
       sample_count
from supply"""

SQL["surge"] = FEATURE_BASE + f"""
select trip_id, demand_60min, {r('supply_baseline')} as supply_baseline,
       {r('surge_multiplier')} as surge_multiplier
from surged"""

SQL["demand_zscore"] = FEATURE_BASE + f"""
select trip_id, {r('demand_zscore')} as demand_zscore from surged"""

SQL["flagship"] = with_(TRIPS, CLEAN, TEMPORAL, DEMAND, SUPPLY, SURGED, ZONES) + f"""
select coalesce(z."Borough", 'Unknown') as borough, s.hour,
       count(*) as trips,
       {r('avg(s.surge_multiplier)')} as avg_surge,
       max(s.demand_60min) as max_demand_60,
       {r('max(s.surge_multiplier)')} as max_surge,
       {r('sum(s.demand_zscore)', 4)} as sum_zscore,
       cast(sum(case when s.surge_multiplier >= 1.2 then 1 else 0 end) as bigint) as surged_trips
from surged s left join zones z on s."PULocationID" = z."LocationID"
group by 1, 2"""

SQL["supply_lookback"] = with_(TRIPS, CLEAN, TEMPORAL, DEMAND) + f""",
hist as (
  select a.trip_id,
         avg(b.demand_60min) as base, stddev_samp(b.demand_60min) as sd
  from demand a join demand b
    on a."PULocationID" = b."PULocationID" and a.hour = b.hour and a.day_of_week = b.day_of_week
   and b.pickup_date < a.pickup_date and b.pickup_date >= a.pickup_date - 28
  group by a.trip_id
),
lb as (
  select d.trip_id, d.demand_60min,
         case when h.base is null or h.base = 0 then 1.0::double else h.base end as supply_baseline,
         h.sd
  from demand d left join hist h using (trip_id)
)
select trip_id, {r('supply_baseline')} as supply_baseline,
       {r('greatest(1.0::double, least(5.0::double, demand_60min / supply_baseline))')} as surge_multiplier,
       {r('case when sd is not null and sd > 0 then (demand_60min - supply_baseline) / sd else 0.0::double end')}
         as demand_zscore
from lb"""


# --- weather / derived / spatial / feature table ------------------------------

SPINE = """
bounds as (
  select date_trunc('hour', min(tpep_pickup_datetime)) as lo,
         date_trunc('hour', max(tpep_pickup_datetime)) as hi
  from trips
),
spine0 as (select unnest(generate_series(lo, hi, interval 1 hour)) as hour_ts from bounds),
spine as (
  select hour_ts, cast(hour_ts as date) as date, cast(hour(hour_ts) as integer) as hour,
         cast(dayofyear(hour_ts) as integer) as day_of_year
  from spine0
)"""


WEATHER = """
cents as (
  select cast(ts as date) as date, cast(hour(ts) as integer) as hour, cast(round(value * 100) as bigint) as c from events
),
wh as (
  select date, hour, count(*) as n, cast(sum(c) as bigint) as total, min(c) as least, max(c) as most from cents group by 1, 2
),
wraw as (
  select date, hour,
         20.0::double + (total % 700) / 10.0::double as temperature_f,
         case when n % 4 = 0 then (most % 50 + 1) / 100.0::double else 0.0::double end as precipitation_in,
         (least % 300) / 10.0::double as wind_speed_mph,
         1.0::double + (most % 90) / 10.0::double as visibility_miles
  from wh
),
weather as (
  select *,
         case when visibility_miles < 3.0 and precipitation_in = 0 then 'Fog'
              when precipitation_in > 0 and temperature_f < 35.0 then 'Snow'
              when precipitation_in > 0 then 'Rain' else 'Clear' end as weather_condition
  from wraw
)"""

WJOIN = """
wjoined as (
  select t.*,
         coalesce(w.temperature_f, 55.0::double) as temperature_f,
         coalesce(w.precipitation_in, 0.0::double) as precipitation_in,
         coalesce(w.wind_speed_mph, 8.0::double) as wind_speed_mph,
         coalesce(w.visibility_miles, 10.0::double) as visibility_miles,
         w.weather_condition,
         case when w.weather_condition = 'Clear' then 1 else 0 end as weather_is_clear,
         case when w.weather_condition = 'Rain' then 1 else 0 end as weather_is_rain,
         case when w.weather_condition = 'Snow' then 1 else 0 end as weather_is_snow,
         case when w.weather_condition = 'Fog' then 1 else 0 end as weather_is_fog
  from SRC t left join weather w on t.pickup_date = w.date and t.hour = w.hour
)"""

DERIVED = """
derived as (
  select *,
    case when trip_distance > 0 then fare_amount / trip_distance else 0.0::double end as fare_per_mile,
    case when trip_duration_minutes > 0 then fare_amount / trip_duration_minutes else 0.0::double end
      as fare_per_minute,
    least(case when trip_duration_minutes > 0 then trip_distance / (trip_duration_minutes / 60)
               else 0.0::double end, 100.0::double) as speed_mph,
    case when demand_60min > 0 then demand_15min / demand_60min else 0.0::double end as demand_acceleration,
    demand_30min - demand_60min as demand_trend,
    case when (case when trip_duration_minutes > 0 then trip_distance / (trip_duration_minutes / 60)
                    else 0.0::double end) > 0
          and (case when trip_duration_minutes > 0 then trip_distance / (trip_duration_minutes / 60)
                    else 0.0::double end) < 10.0 then 1 else 0 end as congestion_indicator
  from SRC
)"""


def frac(x: str) -> str:
    return f"(({x}) - floor({x}))"


def plat(loc: str) -> str:
    v = f"(40.4774::double + {frac(f'cast({loc} as double) * 0.6180339887::double')} * 0.44019999999999726::double)"
    return f"case when {loc} is not null and {loc} > 0 then {v} end"


def plon(loc: str) -> str:
    v = f"(-74.2591::double + {frac(f'cast({loc} as double) * 0.3819660113::double')} * 0.5587000000000018::double)"
    return f"case when {loc} is not null and {loc} > 0 then {v} end"


def hexcell(lat: str, lon: str) -> str:
    x = f"(6371008.8::double * radians(({lon}) - (-74.0::double)) * 0.7581343361976521::double)"
    y = f"(6371008.8::double * radians(({lat}) - 40.7::double))"
    qf = f"((0.5773502691896257::double * {x} - {y} / 3.0::double) / 460.0::double)"
    rf = f"((0.6666666666666666::double * {y}) / 460.0::double)"
    sf = f"(-{qf} - {rf})"
    q, rr, ss = f"floor({qf} + 0.5)", f"floor({rf} + 0.5)", f"floor({sf} + 0.5)"
    dq, dr, ds = f"abs({q} - {qf})", f"abs({rr} - {rf})", f"abs({ss} - {sf})"
    qx = f"case when {dq} > {dr} and {dq} > {ds} then -{rr} - {ss} else {q} end"
    rx = f"case when {dq} > {dr} and {dq} > {ds} then {rr} when {dr} > {ds} then -{q} - {ss} else {rr} end"
    cell = f"'hx_' || cast(cast({qx} as bigint) as varchar) || '_' || cast(cast({rx} as bigint) as varchar)"
    return f"case when ({lat}) is not null and ({lon}) is not null then {cell} end"


SQL["hour_spine"] = with_(TRIPS, SPINE) + "select hour_ts, date, hour, day_of_year from spine"

SQL["weather_classify"] = with_(WEATHER) + f"""
select date, hour, {r('temperature_f')} as temperature_f, {r('precipitation_in')} as precipitation_in,
       {r('wind_speed_mph')} as wind_speed_mph, {r('visibility_miles')} as visibility_miles,
       weather_condition
from weather"""

SQL["weather_file"] = SQL["weather_classify"]

SQL["weather_join"] = with_(TRIPS, CLEAN, TEMPORAL, WEATHER, WJOIN.replace("SRC", "temporal")) + f"""
select trip_id, {r('temperature_f')} as temperature_f, {r('precipitation_in')} as precipitation_in,
       {r('wind_speed_mph')} as wind_speed_mph, {r('visibility_miles')} as visibility_miles,
       weather_condition
from wjoined"""

SQL["weather_onehot"] = with_(TRIPS, CLEAN, TEMPORAL, WEATHER, WJOIN.replace("SRC", "temporal")) + """
select trip_id, weather_is_clear, weather_is_rain, weather_is_snow, weather_is_fog from wjoined"""

SQL["derived_features"] = FEATURE_BASE.rstrip() + "," + DERIVED.replace("SRC", "surged").strip() + f"""
select trip_id, {r('fare_per_mile')} as fare_per_mile, {r('fare_per_minute')} as fare_per_minute,
       {r('speed_mph')} as speed_mph, {r('demand_acceleration')} as demand_acceleration,
       demand_trend, congestion_indicator
from derived"""

SQL["pseudo_coords"] = with_(TRIPS, CLEAN, TEMPORAL) + f"""
select trip_id,
       {r(plat('"PULocationID"'), 8)} as pickup_latitude, {r(plon('"PULocationID"'), 8)} as pickup_longitude,
       {r(plat('"DOLocationID"'), 8)} as dropoff_latitude, {r(plon('"DOLocationID"'), 8)} as dropoff_longitude
from temporal"""

SQL["spatial_fallback"] = with_(TRIPS, CLEAN, TEMPORAL) + """
select trip_id, 'loc_' || cast("PULocationID" as varchar) as h3_pickup_index,
       'loc_' || cast("DOLocationID" as varchar) as h3_dropoff_index
from temporal"""

SQL["hex_bin"] = with_(TRIPS, CLEAN, TEMPORAL) + f"""
select trip_id,
       {hexcell(plat('"PULocationID"'), plon('"PULocationID"'))} as h3_pickup_index,
       {hexcell(plat('"DOLocationID"'), plon('"DOLocationID"'))} as h3_dropoff_index
from temporal"""

FEATURE_SELECT = f"""
select "PULocationID", "DOLocationID",
       'loc_' || cast("PULocationID" as varchar) as h3_pickup_index,
       'loc_' || cast("DOLocationID" as varchar) as h3_dropoff_index,
       pickup_date, hour, day_of_week, day_of_month, month, is_weekend, is_rush_hour,
       {r('trip_distance')} as trip_distance, {r('trip_duration_minutes')} as trip_duration_minutes,
       passenger_count, {r('fare_amount')} as fare_amount, {r('total_amount')} as total_amount,
       demand_15min, demand_30min, demand_60min,
       {r('supply_baseline')} as supply_baseline, {r('demand_zscore')} as demand_zscore,
       {r('fare_per_mile')} as fare_per_mile, {r('fare_per_minute')} as fare_per_minute,
       {r('speed_mph')} as speed_mph, {r('demand_acceleration')} as demand_acceleration,
       demand_trend, congestion_indicator,
       {r('temperature_f')} as temperature_f, {r('precipitation_in')} as precipitation_in,
       {r('wind_speed_mph')} as wind_speed_mph, {r('visibility_miles')} as visibility_miles,
       weather_is_clear, weather_is_rain, weather_is_snow, weather_is_fog,
       {r('surge_multiplier')} as surge_multiplier
from derived"""

FEATURES_CTE = with_(
    TRIPS, CLEAN, TEMPORAL, DEMAND, SUPPLY, SURGED, WEATHER,
    WJOIN.replace("SRC", "surged"), DERIVED.replace("SRC", "wjoined"),
)

SQL["feature_table"] = FEATURES_CTE + FEATURE_SELECT

SQL["feature_roundtrip"] = SQL["feature_table"]

SQL["features_range"] = SQL["feature_table"] + " where pickup_date between date '2024-01-08' and date '2024-01-14'"

SQL["output_directories"] = BASE + """
select 'pickup_date=' || cast(pickup_date as varchar) || '/hour=' || cast(hour as varchar) as directory, count(*) as n_rows
from temporal group by 1"""

SQL["saturation_zones"] = with_(TRIPS, CLEAN, TEMPORAL, DEMAND, SUPPLY, SURGED, ZONES) + f"""
select s."PULocationID", any_value(z."Borough") as borough, any_value(z."Zone") as zone, s.hour, count(*) as trips,
       {r('avg(case when s.surge_multiplier >= 1.2 then 1.0::double else 0.0::double end)')} as surged_share,
       sum(case when s.surge_multiplier >= 1.2 then 1 else 0 end) * 2 >= count(*) as saturated
from surged s left join zones z on s."PULocationID" = z."LocationID"
group by s."PULocationID", s.hour"""

SQL["partition_roundtrip"] = with_(TRIPS, CLEAN, TEMPORAL, ZONES) + f"""
select t.trip_id, t.pickup_date, t.hour, t."PULocationID", pz."Borough" as pickup_borough,
       dz."Zone" as dropoff_zone, {r('t.trip_duration_minutes')} as trip_duration_minutes
from temporal t
left join zones pz on t."PULocationID" = pz."LocationID"
left join zones dz on t."DOLocationID" = dz."LocationID"
"""


# --- model phase ------------------------------------------------------------------

MODEL_FEATURE_NAMES = (
    "hour day_of_week day_of_month month is_weekend is_rush_hour PULocationID DOLocationID "
    "trip_distance trip_duration_minutes passenger_count fare_amount total_amount demand_15min "
    "demand_30min demand_60min supply_baseline demand_zscore fare_per_mile fare_per_minute speed_mph "
    "demand_acceleration demand_trend congestion_indicator temperature_f precipitation_in "
    "wind_speed_mph visibility_miles weather_is_clear weather_is_rain weather_is_snow weather_is_fog"
).split()

SPLIT = "(cast(('0x' || substr(md5('42:' || cast(trip_id as varchar)), 1, 8)) as bigint) % 100 < 20)"

MODEL_CTE = FEATURES_CTE.rstrip() + f""",
prepared as (
  select trip_id, {SPLIT} as is_validation,
         {", ".join(
             (f'coalesce(cast(passenger_count as double), (select median(passenger_count) from derived)) as passenger_count'
              if c == "passenger_count" else f'cast("{c}" as double) as "{c}"')
             for c in MODEL_FEATURE_NAMES)},
         surge_multiplier
  from derived
),
scored as (
  select trip_id, {SPLIT} as is_validation, surge_multiplier,
         0.5::double + 0.4::double * demand_60min / supply_baseline + 0.1::double * is_rush_hour
           + 0.05::double * weather_is_rain as prediction
  from derived
)
"""

SQL["median_fill"] = MODEL_CTE + f"select trip_id, {r('passenger_count')} as passenger_count from prepared"

SQL["feature_matrix"] = MODEL_CTE + "select trip_id, " + ", ".join(
    f'{r(chr(34) + c + chr(34))} as "{c}"' for c in MODEL_FEATURE_NAMES
) + f", {r('surge_multiplier')} as surge_multiplier from prepared"

SQL["train_val_split"] = MODEL_CTE + "select trip_id, is_validation from prepared"

SQL["asym_grad_hess"] = MODEL_CTE + f"""
select trip_id, {r('prediction')} as prediction,
       {r('case when surge_multiplier - prediction > 0 then -4.0 * (surge_multiplier - prediction) else -2.0 * (surge_multiplier - prediction) end')} as grad,
       {r('case when surge_multiplier - prediction > 0 then 4.0::double else 2.0::double end')} as hess
from scored"""

WSE = "(case when surge_multiplier - prediction > 0 then 2.0 else 1.0 end) * (surge_multiplier - prediction) * (surge_multiplier - prediction)"

SQL["asym_wmse"] = MODEL_CTE + f"select {r(f'avg({WSE})')} as asymmetric_wmse from scored where is_validation"

SQL["eval_metrics"] = MODEL_CTE + f"""
select {r('sqrt(avg((surge_multiplier - prediction) * (surge_multiplier - prediction)))')} as rmse,
       {r('avg(abs(surge_multiplier - prediction))')} as mae,
       {r('1 - sum((surge_multiplier - prediction) * (surge_multiplier - prediction)) / (var_pop(surge_multiplier) * count(surge_multiplier))')} as r2_score,
       {r('avg(case when surge_multiplier > 0 then abs((surge_multiplier - prediction) / surge_multiplier) end) * 100')} as mape_percent,
       {r('avg(case when (surge_multiplier >= 1.2) = (prediction >= 1.2) then 1.0 else 0.0 end) * 100')} as directional_accuracy_percent,
       {r('coalesce(avg(case when surge_multiplier >= 1.2 then (case when prediction < surge_multiplier then 1.0 else 0.0 end) end) * 100, 0.0)')} as under_estimation_rate_percent,
       {r(f'avg({WSE})')} as asymmetric_wmse,
       count(*) as n_rows
from scored where is_validation"""

SQL["score_scenarios"] = FEATURES_CTE.rstrip() + f""",
scen as (
  select trip_id,
         (demand_60min - 120.0::double) / 40.0::double as demand_zscore,
         cast(case when day_of_week in (1, 7) then 1 else 0 end as double) as is_weekend,
         cast(case when hour between 7 and 9 or hour between 16 and 19 then 1 else 0 end as double) as is_rush_hour,
         cast(case when precipitation_in > 0.1 then 1 else 0 end as double) as weather_is_rain,
         cast(demand_60min as double) as demand_60min, cast(supply_baseline as double) as supply_baseline
  from derived
),
pred as (
  select *, greatest(1.0::double, 0.5::double + 0.4::double * demand_60min / supply_baseline
                     + 0.1::double * is_rush_hour + 0.05::double * weather_is_rain) as predicted_surge
  from scen
)
select trip_id, {r('demand_zscore')} as demand_zscore, is_weekend, is_rush_hour, weather_is_rain,
       {r('predicted_surge')} as predicted_surge,
       case when predicted_surge < 1.2 then 'Low' when predicted_surge > 2.0 then 'High' else 'Moderate' end as surge_band,
       case when predicted_surge >= 1.0 and predicted_surge < 1.5 then 'green'
            when predicted_surge >= 1.5 and predicted_surge < 2.5 then 'yellow'
            when predicted_surge >= 2.5 and predicted_surge <= 5.0 then 'red' end as gauge_band,
       case when predicted_surge >= 4.5 then 1 else 0 end as surge_alert
from pred"""

SQL["surge_bands"] = FEATURES_CTE + f"""
select trip_id, {r('surge_multiplier')} as surge_multiplier,
       case when surge_multiplier < 1.2 then 'Low' when surge_multiplier > 2.0 then 'High' else 'Moderate' end as surge_band,
       case when surge_multiplier >= 1.0 and surge_multiplier < 1.5 then 'green'
            when surge_multiplier >= 1.5 and surge_multiplier < 2.5 then 'yellow'
            when surge_multiplier >= 2.5 and surge_multiplier <= 5.0 then 'red' end as gauge_band,
       case when surge_multiplier >= 4.5 then 1 else 0 end as surge_alert
from derived"""

SQL["stream_etl"] = SQL["partition_roundtrip"]

SCENARIO_PRED = SQL["score_scenarios"][: SQL["score_scenarios"].index("select trip_id, ", SQL["score_scenarios"].index("pred as ("))]

SQL["scenario_report"] = SCENARIO_PRED + """
select trip_id,
       printf('%.2f', predicted_surge) || 'x' as surge_text,
       printf('%.2f', demand_zscore) as zscore_text,
       case when is_rush_hour = 1 then 'Yes' else 'No' end as rush_hour_text,
       case when is_weekend = 1 then 'Yes' else 'No' end as weekend_text,
       case when weather_is_rain = 1 then 'Yes' else 'No' end as raining_text
from pred"""

SQL["contract_report"] = BASE + """
select count(*) as n_rows,
       min(trip_distance) as min_trip_distance, max(trip_distance) as max_trip_distance,
       min(fare_amount) as min_fare_amount, max(fare_amount) as max_fare_amount,
       min(total_amount) as min_total_amount,
       cast(min(year(tpep_pickup_datetime)) as integer) as min_pickup_year,
       cast(max(year(tpep_pickup_datetime)) as integer) as max_pickup_year,
       min(hour) as min_hour, max(hour) as max_hour,
       min(trip_duration_minutes) as min_duration, max(trip_duration_minutes) as max_duration,
       cast(sum(case when is_weekend not in (0, 1) then 1 else 0 end
              + case when is_rush_hour not in (0, 1) then 1 else 0 end) as bigint) as bad_flags,
       cast(sum(case when passenger_count is null then 1 else 0 end) as bigint) as null_passengers
from temporal"""

# --- boosting that SQL can follow ------------------------------------------------

SQL["actual_vs_predicted"] = FEATURES_CTE + f"""
select pickup_date, hour, count(*) as trips, {r('avg(surge_multiplier)')} as actual_surge,
       {r('avg(0.5::double + 0.4::double * demand_60min / supply_baseline + 0.1::double * is_rush_hour + 0.05::double * weather_is_rain)')}
         as predicted_surge
from derived group by 1, 2"""

# The expectile: the value m between two labels at which twice the labels above
# and once those below balance.
EXPECTILE = """,
label_counts as (select surge_multiplier as v, count(*) as n from prepared where not is_validation group by 1),
running as (
  select v, lead(v) over (order by v) as next_v,
         sum(n) over (order by v) as nl, sum(n * v) over (order by v) as sl,
         sum(n) over () as n_all, sum(n * v) over () as s_all
  from label_counts
),
base as (
  select (2.0 * (s_all - sl) + sl) / (2.0 * (n_all - nl) + nl) as m from running
  where v <= (2.0 * (s_all - sl) + sl) / (2.0 * (n_all - nl) + nl)
    and (next_v is null or (2.0 * (s_all - sl) + sl) / (2.0 * (n_all - nl) + nl) < next_v)
  order by v limit 1
)"""

SQL["base_score"] = MODEL_CTE.rstrip() + EXPECTILE + f"select {r('m')} as base_score from base"

STUMP = """,
residuals as (select is_rush_hour, surge_multiplier - m as r from prepared, base where not is_validation),
sides as (
  select is_rush_hour, sum(case when r > 0 then -4.0 * r else -2.0 * r end) as g, sum(case when r > 0 then 4.0 else 2.0 end) as h
  from residuals group by 1
),
split as (
  select max(case when is_rush_hour = 0 then g end) as gl, max(case when is_rush_hour = 0 then h end) as hl,
         max(case when is_rush_hour = 1 then g end) as gr, max(case when is_rush_hour = 1 then h end) as hr
  from sides
),
stump as (
  select 0.05 * -sign(gl) * greatest(abs(gl) - 0.1, 0) / (hl + 1.0) as left_value,
         0.05 * -sign(gr) * greatest(abs(gr) - 0.1, 0) / (hr + 1.0) as right_value,
         0.5 * (pow(greatest(abs(gl) - 0.1, 0), 2) / (hl + 1.0) + pow(greatest(abs(gr) - 0.1, 0), 2) / (hr + 1.0)
                - pow(greatest(abs(gl + gr) - 0.1, 0), 2) / (hl + hr + 1.0)) as gain
  from split
)"""

SQL["boost_stump"] = MODEL_CTE.rstrip() + EXPECTILE + STUMP + f"""
select 0 as tree, 'is_rush_hour' as feature, 0.5::double as threshold, {r('gain')} as gain,
       {r('left_value')} as left_value, {r('right_value')} as right_value
from stump"""

SQL["stump_scenarios"] = MODEL_CTE.rstrip() + EXPECTILE + STUMP + f""",
pred as (
  select trip_id, is_rush_hour, m + case when is_rush_hour = 1 then right_value else left_value end as prediction,
         greatest(1.0::double, m + case when is_rush_hour = 1 then right_value else left_value end) as predicted_surge
  from prepared, base, stump
)
select trip_id, is_rush_hour, {r('prediction')} as prediction, {r('predicted_surge')} as predicted_surge,
       case when predicted_surge < 1.2 then 'Low' when predicted_surge > 2.0 then 'High' else 'Moderate' end as surge_band,
       case when predicted_surge >= 1.0 and predicted_surge < 1.5 then 'green'
            when predicted_surge >= 1.5 and predicted_surge < 2.5 then 'yellow'
            when predicted_surge >= 2.5 and predicted_surge <= 5.0 then 'red' end as gauge_band,
       case when predicted_surge >= 4.5 then 1 else 0 end as surge_alert
from pred"""

SQL["score_topk"] = MODEL_CTE.rstrip() + ",\nmeans as (\n" + "\nunion all\n".join(
    f"""select '{c}' as feature, round(avg("{c}"), 4) as score from prepared""" for c in MODEL_FEATURE_NAMES
) + """
)
select feature, score, cast(row_number() over (order by score desc, feature) as integer) as rank
from means order by score desc, feature limit 20"""

SQL["warm_start_batches"] = MODEL_CTE + """
select trip_id, cast(cast(('0x' || substr(md5('batch:' || cast(trip_id as varchar)), 1, 8)) as bigint) % 4 as integer) as batch
from prepared"""


# --- several rounds over features of two values ------------------------------------

BINARY = ("is_weekend", "is_rush_hour", "congestion_indicator", "weather_is_rain")


def rounds_sql(conditions) -> str:
    """CTEs best0.. (f, gain, cover, left_value, ...) and pred0.. (predictions before each round) for one split a round.

    ``conditions`` are the training rows of each round.
    """
    out = [f"""pred0 as (
  select trip_id, is_validation, surge_multiplier, {", ".join(f'"{c}" as f{i}' for i, c in enumerate(BINARY))}, m as p from prepared, base
)"""]
    for k, rows in enumerate(conditions):
        long = " union all ".join(f"select {i} as f, f{i} as v, r from (select *, surge_multiplier - p as r from pred{k} where {rows})" for i in range(len(BINARY)))
        picked = "case b.f " + " ".join(f"when {i} then f{i}" for i in range(len(BINARY))) + " end"
        out.append(f"""sides{k} as (
  select f, sum(case when v = 0 then (case when r > 0 then -4.0 * r else -2.0 * r end) end) as gl, sum(case when v = 0 then (case when r > 0 then 4.0::double else 2.0::double end) end) as hl,
         sum(case when v = 1 then (case when r > 0 then -4.0 * r else -2.0 * r end) end) as gr, sum(case when v = 1 then (case when r > 0 then 4.0::double else 2.0::double end) end) as hr
  from ({long}) group by f
),
best{k} as (
  select f, hl, hl + hr as cover, 0.3 * -sign(gl) * greatest(abs(gl) - 0.1, 0) / (hl + 1.0) as left_value,
         0.3 * -sign(gr) * greatest(abs(gr) - 0.1, 0) / (hr + 1.0) as right_value,
         0.5 * (pow(greatest(abs(gl) - 0.1, 0), 2) / (hl + 1.0) + pow(greatest(abs(gr) - 0.1, 0), 2) / (hr + 1.0)
                - pow(greatest(abs(gl + gr) - 0.1, 0), 2) / (hl + hr + 1.0)) as gain
  from sides{k} where gl is not null and gr is not null order by gain desc, f limit 1
),
pred{k + 1} as (
  select pred{k}.* replace (p + case when {picked} = 0 then b.left_value else b.right_value end as p) from pred{k}, best{k} b
)""")
    names = "case f " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(BINARY)) + " end"
    out.append("splits as (" + " union all ".join(f"select {k} as tree, {names} as feature, gain, cover, left_value, right_value, hl as left_cover from best{k}" for k in range(len(conditions))) + ")")
    return ",\n" + ",\n".join(out)


ROUNDS = MODEL_CTE.rstrip() + EXPECTILE + rounds_sql(["not is_validation"] * 4)
SPLITS = f"""
select tree, feature, 0.5::double as threshold, {r('gain')} as gain, {r('cover')} as cover, {r('left_value')} as left_value,
       {r('right_value')} as right_value, {r('left_cover')} as left_cover
from splits"""

SQL["boost_rounds"] = SQL["train_resume"] = ROUNDS + SPLITS

BATCH = "cast(('0x' || substr(md5('batch:' || cast(trip_id as varchar)), 1, 8)) as bigint) % 2"

SQL["warm_start_rounds"] = MODEL_CTE.rstrip() + EXPECTILE + rounds_sql([f"not is_validation and {BATCH} = {k // 2}" for k in range(4)]) + SPLITS

SQL["model_importance"] = ROUNDS + f"""
select feature, count(*) as weight, {r('avg(gain)')} as gain, {r('avg(cover)')} as cover, {r('sum(gain)')} as total_gain, {r('sum(cover)')} as total_cover
from splits group by feature"""

SQL["model_metrics"] = ROUNDS + f""",
scored4 as (select surge_multiplier, p as prediction, is_validation from pred4)
select {SQL["eval_metrics"].split("select ")[-1].split("from scored")[0].rstrip()},
       4 as n_trees, {len(BINARY)} as n_features, (select feature from splits group by feature order by round(avg(gain), 4) desc, feature limit 1) as top_feature,
       (select count(distinct feature) from splits) as n_top
from scored4 where is_validation"""

SQL["importance_file"] = ROUNDS + f"""
select cast(n.i as integer) as ordinal, n.name as feature, {r('avg(s.gain)')} as importance_gain
from (values {", ".join(f"({i}, '{c}')" for i, c in enumerate(BINARY))}) n(i, name) left join splits s on s.feature = n.name
group by n.i, n.name"""

SQL["scan_drift"] = with_(TRIPS) + f"""
select trip_id, {r('cast(passenger_count as double)')} as passenger_count, cast("PULocationID" as bigint) as "PULocationID",
       {r('trip_distance')} as trip_distance, case when trip_id % 3 > 0 then {r('total_amount / 4.0::double')} end as airport_fee
from trips"""

SQL["stream_demand"] = SQL["rolling_demand"]

SQL["stream_zones"] = with_(TRIPS, CLEAN, TEMPORAL, ZONES) + """,
versions as (
  select "LocationID", "Borough", "Zone", timestamp '2024-01-01 00:00:00' as valid_from,
         case when "LocationID" % 2 = 0 then timestamp '2024-01-15 12:00:00' end as valid_to from zones
  union all
  select "LocationID", upper("Borough"), 'New ' || "Zone", timestamp '2024-01-15 12:00:00', null from zones where "LocationID" % 2 = 0
)
select t.trip_id, t.pickup_date, t.hour, p."Borough" as pickup_borough, p."Zone" as pickup_zone, d."Borough" as dropoff_borough, d."Zone" as dropoff_zone
from temporal t
left join versions p on t."PULocationID" = p."LocationID" and t.tpep_pickup_datetime >= p.valid_from
  and (p.valid_to is null or t.tpep_pickup_datetime < p.valid_to)
left join versions d on t."DOLocationID" = d."LocationID" and t.tpep_pickup_datetime >= d.valid_from
  and (d.valid_to is null or t.tpep_pickup_datetime < d.valid_to)"""


# --- counts of the running write, buckets, cells, sketches ---------------------------

SQL["joinback_bucketed"] = with_(TRIPS, CLEAN, TEMPORAL, DEMAND, SUPPLY, SURGED) + f"""
select trip_id, demand_60min, {r('supply_baseline')} as supply_baseline, {r('surge_multiplier')} as surge_multiplier from surged"""

SQL["etl_counts"] = with_(TRIPS, CLEAN, TEMPORAL, ZONES) + """
select count(*) as n_raw,
       count(*) filter (tpep_pickup_datetime is null) as null_pickup, count(*) filter (tpep_dropoff_datetime is null) as null_dropoff,
       count(*) filter (coalesce(year(tpep_pickup_datetime), 0) <> 2024) as other_year,
       count(*) filter (not coalesce(trip_distance between 0.1 and 200.0, false)) as bad_distance,
       count(*) filter (not coalesce(fare_amount between 1.0 and 5000.0, false)) as bad_fare,
       count(*) filter (not (passenger_count is null or passenger_count between 1 and 9)) as bad_passengers,
       count(*) filter (not coalesce(total_amount > 0, false)) as bad_total,
       (select count(*) from zones) as n_zones, (select count(*) from temporal) as n_kept,
       (select count(*) from temporal where passenger_count is null) as null_passenger_count,
       (select count(*) from temporal t left join zones z on t."PULocationID" = z."LocationID" where z."Borough" is null) as null_pickup_borough,
       (select count(*) from temporal t left join zones z on t."DOLocationID" = z."LocationID" where z."Borough" is null) as null_dropoff_borough,
       true as bytes_agree
from trips"""

SQL["quantile_ranks"] = with_(TRIPS, CLEAN, TEMPORAL) + """,
days as (select * from temporal where pickup_date between date '2024-01-08' and date '2024-01-14'),
counted as (
  select 'trip_distance' as "column", count(trip_distance) as n from days union all
  select 'fare_amount', count(fare_amount) from days union all
  select 'trip_duration_minutes', count(trip_duration_minutes) from days
)
select "column", p, n, true as within_bound from counted, (select unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]::double[]) as p)
where n > 0"""


def path_sql(x: str, y: str, levels: int) -> str:
    return f"array_to_string(list_transform(range({levels} - 1, -1, -1), lambda b: ((({y}) >> b) & 1) * 2 + ((({x}) >> b) & 1)), '')"


SQL["coordinate_cells"] = with_(TRIPS, CLEAN, TEMPORAL) + f""",
placed as (
  select trip_id, {plat('"PULocationID"')} + trip_id % 1000 / 20000.0::double as plat, {plon('"PULocationID"')} as plon,
         {plat('"DOLocationID"')} + trip_id % 1000 / 20000.0::double as dlat, {plon('"DOLocationID"')} as dlon
  from temporal
),
cells as (
  select *, cast(floor((plon + 180.0::double) / 360.0::double * 65536.0::double) as bigint) as x,
         cast(floor((plat + 90.0::double) / 180.0::double * 65536.0::double) as bigint) as y
  from placed
),
around as (
  select trip_id, string_agg({path_sql('x + i', 'y + j', 16)}, ',' order by {path_sql('x + i', 'y + j', 16)}) as around
  from cells, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j) where i <> 0 or j <> 0
  group by trip_id
)
select trip_id, {hexcell('plat', 'plon')} as h3_pickup_index, {hexcell('dlat', 'dlon')} as h3_dropoff_index,
       {path_sql('x', 'y', 16)} as fine_path, {path_sql('x >> 4', 'y >> 4', 12)} as coarse_path, true as contained, around
from cells join around using (trip_id)"""
