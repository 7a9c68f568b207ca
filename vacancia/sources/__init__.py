"""Feed mappers by name."""

from .boards import map_board_rows
from .json_feeds import (
    map_arbeitnow,
    map_ashby,
    map_greenhouse,
    map_lever,
    map_remotive,
    map_smartrecruiters,
    map_workday_detail,
    map_workday_search,
)
from .pages import (
    map_foundit_cards,
    map_generic_page,
    map_instahyre_cards,
    map_personio_listing,
    map_personio_page,
    map_personio_xml,
)

MAPPERS = {
    "greenhouse": map_greenhouse,
    "lever": map_lever,
    "ashby": map_ashby,
    "smartrecruiters": map_smartrecruiters,
    "personio_xml": map_personio_xml,
    "personio_listing": map_personio_listing,
    "personio_page": map_personio_page,
    "workday_search": map_workday_search,
    "workday_detail": map_workday_detail,
    "arbeitnow": map_arbeitnow,
    "remotive": map_remotive,
    "foundit": map_foundit_cards,
    "instahyre": map_instahyre_cards,
    "board": map_board_rows,
    "generic_page": map_generic_page,
}
