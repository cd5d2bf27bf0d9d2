"""Views that the SQL of the queries starts from: tidied tables, as sources/tables.py makes them."""

PRE = """with n as (select * from graph_nodes qualify row_number() over (partition by id) = 1),
e as (select * exclude (from_id, to_id), case when trim(from_id) <> '' then lower(trim(from_id)) end as from_id,
  case when trim(to_id) <> '' then lower(trim(to_id)) end as to_id from graph_edges qualify row_number() over (partition by id) = 1),
an as (select * from n where t_valid_until is null and archived_at is null),
ae as (select * from e where t_valid_until is null),
m as (select distinct community_id, lower(trim(entity_id)) as entity_id, level from community_members),
h as (select * from hook_events qualify row_number() over (partition by event_id) = 1),
hub as (select to_id as id from ae where to_id is not null group by to_id order by count(*) desc, to_id limit 1)
"""
