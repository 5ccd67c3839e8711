"""DataFrame -> DataFrame operators (use with ``df.transform``)."""

from surgelane.operators.boost import BoostedTrees, train_boosted, train_warm_start  # noqa: F401
from surgelane.operators.demand import demand_profile, rolling_demand  # noqa: F401
from surgelane.operators.derived import add_derived_features  # noqa: F401
from surgelane.operators.dimensions import (  # noqa: F401
    DuplicateDimensionKey,
    add_placeholder_zones,
    enrich_zones,
    join_dimension,
    join_zones,
)
from surgelane.operators.evaluate import asymmetric_wmse, evaluate_predictions, top_k  # noqa: F401
from surgelane.operators.prep import prepare_features, train_val_split  # noqa: F401
from surgelane.operators.quality import apply_quality_filters, duration_filter  # noqa: F401
from surgelane.operators.scoring import add_bands, align_features, score_scenarios  # noqa: F401
from surgelane.operators.spatial import add_pseudo_coordinates, add_spatial_index  # noqa: F401
from surgelane.operators.supply import (  # noqa: F401
    compute_supply_and_surge,
    supply_baseline,
    surge_features,
    surge_profile,
)
from surgelane.operators.temporal import extract_temporal_features  # noqa: F401
from surgelane.operators.weather import (  # noqa: F401
    hour_spine,
    integrate_weather,
    weather_onehot,
    year_spine,
)
