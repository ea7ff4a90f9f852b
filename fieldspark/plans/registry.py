"""All queries of the library and their SQL."""

from . import field, fusion, jobs, losses, maps, measurement, network, obstacles, rays, sensing

MODULES = (measurement, field, fusion, network, obstacles, losses, sensing, maps, rays, jobs)
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
