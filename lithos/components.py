"""The component set that the Python surface ships with."""

from __future__ import annotations

from lithos.world import World

#: Fixed names and types. Unsigned 32-bit and 8-bit numbers are widened.
COMPONENTS = {
    "Position": "struct<pos_x:float,pos_y:float>",
    "Velocity": "struct<vel_x:float,vel_y:float>",
    "Acceleration": "struct<acc_x:float,acc_y:float>",
    "Mass": "struct<mass:float>",
    "CellState": "struct<alive:boolean>",
    "Heading": "struct<heading:float>",
    "Energy": "struct<energy:float>",
    "Health": "struct<health:bigint>",
    "Faction": "struct<faction:smallint>",
    "WormSize": "struct<worm_size:float>",
    "Nutrition": "struct<nutrition:float>",
}


def register_all(world: World) -> None:
    for name, kind in COMPONENTS.items():
        world.register(name, kind)
