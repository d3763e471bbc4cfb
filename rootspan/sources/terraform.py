"""Terraform state → nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.functions.classify import lookup
from rootspan.operators.graph import dedupe_edges, dedupe_nodes, drop_dangling
from rootspan.scratch import materialize
from rootspan.sources.positions import positioned
from rootspan.sources.inventory import arm_id, make_edge, make_node

STATE = "resources array<struct<mode:string,type:string,module:string,name:string,depends_on:array<string>,instances:array<struct<index_key:string,attributes:map<string,string>>>>>"
# Class of a resource type.
TYPE_CLASSES = {
    "azurerm_virtual_machine": "VirtualMachine", "azurerm_linux_virtual_machine": "VirtualMachine", "azurerm_windows_virtual_machine": "VirtualMachine", "azurerm_virtual_machine_scale_set": "VirtualMachineScaleSet",
    "azurerm_linux_virtual_machine_scale_set": "VirtualMachineScaleSet", "azurerm_windows_virtual_machine_scale_set": "VirtualMachineScaleSet", "azurerm_managed_disk": "Disk", "azurerm_availability_set": "AvailabilitySet",
    "azurerm_image": "Image", "azurerm_snapshot": "Snapshot", "azurerm_kubernetes_cluster": "AKSCluster", "azurerm_kubernetes_cluster_node_pool": "AKSNodePool",
    "azurerm_container_registry": "ContainerRegistry", "azurerm_container_group": "ContainerGroup", "azurerm_container_app": "ContainerApp", "azurerm_container_app_environment": "ContainerAppEnvironment",
    "azurerm_virtual_network": "VirtualNetwork", "azurerm_subnet": "Subnet", "azurerm_network_interface": "NetworkInterface", "azurerm_network_security_group": "NetworkSecurityGroup",
    "azurerm_public_ip": "PublicIP", "azurerm_lb": "LoadBalancer", "azurerm_application_gateway": "Gateway", "azurerm_frontdoor": "FrontDoor",
    "azurerm_private_dns_zone": "PrivateDNS", "azurerm_dns_zone": "DNS", "azurerm_route_table": "RouteTable", "azurerm_private_endpoint": "PrivateEndpoint",
    "azurerm_bastion_host": "BastionHost", "azurerm_firewall": "Firewall", "azurerm_nat_gateway": "NATGateway", "azurerm_virtual_network_gateway": "VNetGateway",
    "azurerm_local_network_gateway": "LocalNetGateway", "azurerm_virtual_network_peering": "VNetPeering", "azurerm_user_assigned_identity": "ManagedIdentity", "azurerm_key_vault": "KeyVault",
    "azurerm_key_vault_secret": "KeyVaultSecret", "azurerm_key_vault_certificate": "KeyVaultCert", "azurerm_key_vault_key": "KeyVaultKey", "azurerm_mssql_server": "SqlServer",
    "azurerm_mssql_database": "SqlDatabase", "azurerm_mssql_elasticpool": "SqlElasticPool", "azurerm_mysql_flexible_server": "MySqlServer", "azurerm_postgresql_flexible_server": "PostgresServer",
    "azurerm_cosmosdb_account": "CosmosDB", "azurerm_redis_cache": "RedisCache", "azurerm_redis_enterprise_cluster": "RedisEnterprise", "azurerm_storage_account": "StorageAccount",
    "azurerm_storage_container": "StorageContainer", "azurerm_storage_share": "StorageShare", "azurerm_eventhub_namespace": "EventHub", "azurerm_servicebus_namespace": "ServiceBus",
    "azurerm_eventgrid_topic": "EventGridTopic", "azurerm_service_plan": "AppServicePlan", "azurerm_linux_web_app": "AppService", "azurerm_windows_web_app": "AppService",
    "azurerm_linux_function_app": "FunctionApp", "azurerm_windows_function_app": "FunctionApp", "azurerm_static_web_app": "StaticWebApp", "azurerm_cdn_frontdoor_profile": "FrontDoorCDN",
    "azurerm_api_management": "APIManagement", "azurerm_application_insights": "AppInsights", "azurerm_log_analytics_workspace": "LogAnalytics", "azurerm_monitor_action_group": "ActionGroup",
    "azurerm_logic_app_workflow": "LogicApp", "azurerm_resource_group": "ResourceGroup", "azurerm_data_factory": "DataFactory", "kubernetes_deployment": "KubernetesDeployment",
    "kubernetes_service": "KubernetesService", "kubernetes_namespace": "KubernetesNamespace", "helm_release": "HelmRelease",
}
# Types that are edges, with the attributes of source and target.
ASSOCIATIONS = {
    "azurerm_subnet_network_security_group_association": ("network_security_group_id", "subnet_id"),
    "azurerm_subnet_route_table_association": ("route_table_id", "subnet_id"),
    "azurerm_subnet_nat_gateway_association": ("nat_gateway_id", "subnet_id"),
    "azurerm_network_interface_security_group_association": ("network_security_group_id", "network_interface_id"),
}
# Attributes that hold the id of another resource.
REFERENCES = [
    "resource_group_id", "virtual_network_id", "subnet_id", "network_interface_id", "network_security_group_id", "route_table_id", "nat_gateway_id", "public_ip_address_id", "key_vault_id",
    "storage_account_id", "log_analytics_workspace_id", "application_insights_id", "managed_disk_id", "availability_set_id", "container_registry_id", "dns_zone_id", "private_dns_zone_id",
    "firewall_policy_id", "kubernetes_cluster_id", "service_plan_id", "eventhub_namespace_id", "servicebus_namespace_id", "cosmosdb_account_id", "mssql_server_id", "user_assigned_identity_id",
]


def tf_instances(state: DataFrame, types: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """A row for each instance of a managed resource: own id, address, type, module, attributes, depends_on.

    ``place``: the state by ``order_col``, else by its place in the input (``input_position``), and the places of resource and instance in it.

    The id is the cloud id, else ``tf://`` and the address; the address has the module before it and the index after it.
    """
    rows = positioned(state, "_row", order_col).select(F.col("_row").alias("row"), F.posexplode("resources").alias("pos", "r")).where("coalesce(r.mode, 'managed') = 'managed'")
    rows = rows.select("row", "pos", "r.type", "r.module", "r.name", "r.depends_on", F.posexplode("r.instances").alias("inst", "i"))
    if types:
        rows = rows.where(F.col("type").isin(types))
    address = F.concat_ws(".", F.nullif("module", F.lit("")), "type", "name")
    address = F.concat(address, F.when(F.col("i.index_key").isNotNull(), F.concat(F.lit("["), "i.index_key", F.lit("]"))).otherwise(""))
    rows = rows.select(F.struct("row", "pos", "inst").alias("place"), "type", "module", "name", "depends_on", address.alias("address"), F.coalesce("i.attributes", F.create_map().cast("map<string,string>")).alias("a"))
    cloud = arm_id(F.try_element_at("a", F.lit("id")))
    return rows.withColumn("own", F.when(cloud == "", F.concat(F.lit("tf://"), "address")).otherwise(cloud))


def _attr(name: str) -> Column:
    return F.try_element_at("a", F.lit(name))


def tf_nodes(instances: DataFrame, *keep: str) -> DataFrame:
    """A node for each instance that is no association, with further columns ``keep``."""
    other = F.when(F.col("type").contains("_"), F.initcap(F.replace(F.regexp_replace("type", "^[^_]*_", ""), F.lit("_"), F.lit(" ")))).otherwise(F.col("type"))
    cls = lookup(F.col("type"), TYPE_CLASSES, F.replace(other, F.lit(" "), F.lit("_")))
    properties = F.create_map(F.lit("tf_address"), F.col("address"), F.lit("tf_type"), F.col("type"), F.lit("resource_group"), F.coalesce(_attr("resource_group_name"), F.lit("")))
    own = instances.where(~F.col("type").isin(list(ASSOCIATIONS)))
    return own.select(*make_node(F.col("own"), F.coalesce(_attr("name"), F.col("name")), cls, F.coalesce(_attr("location"), F.lit("")), properties), *keep)


def tf_reference_edges(instances: DataFrame) -> DataFrame:
    """Edges from the resources whose ids an instance's attributes hold."""
    refs = instances.where(~F.col("type").isin(list(ASSOCIATIONS))).select("own", F.explode("a").alias("key", "value"))
    refs = refs.where(F.col("key").isin(REFERENCES) & F.col("value").startswith("/"))
    return refs.select(*make_edge(arm_id(F.col("value")), F.col("own")))


def tf_depends_on_edges(instances: DataFrame, resolve_modules: bool = False) -> DataFrame:
    """Edges from declared dependencies that resolve to an address of the state; others are dropped.

    By default ``module.`` is taken off the dependency but not off the addresses, so those in modules
    don't resolve; ``resolve_modules`` compares both without it and without an index.
    """
    bare = lambda c: F.replace(c, F.lit("module."), F.lit(""))
    rows = instances.where(~F.col("type").isin(list(ASSOCIATIONS)))
    address = F.regexp_replace(bare(F.col("address")), r"\[[^\]]*\]$", "") if resolve_modules else F.col("address")
    known = rows.select(address.alias("dep"), F.col("own").alias("source"), "place").groupBy("dep").agg(F.max_by("source", "place").alias("source"))
    asked = rows.select("own", F.explode("depends_on").alias("d")).select("own", F.trim(bare(F.col("d"))).alias("dep"))
    return asked.join(known, "dep").select(*make_edge(F.col("source"), F.col("own")))


def tf_association_edges(instances: DataFrame) -> DataFrame:
    """The edges that association resources stand for."""
    source = reduce(lambda acc, kv: F.when(F.col("type") == kv[0], _attr(kv[1][0])).otherwise(acc), ASSOCIATIONS.items(), F.lit(None).cast("string"))
    target = reduce(lambda acc, kv: F.when(F.col("type") == kv[0], _attr(kv[1][1])).otherwise(acc), ASSOCIATIONS.items(), F.lit(None).cast("string"))
    rows = instances.where(F.col("type").isin(list(ASSOCIATIONS)))
    return rows.select(*make_edge(arm_id(source), arm_id(target))).where("source_id <> '' and target_id <> ''")


def tf_graph(state: DataFrame, types: list[str] | None = None, resolve_modules: bool = False, order_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, dangling)`` of one or more states; the last instance of an id in the order of states and inside them and the first edge of a key win."""
    rows = materialize(tf_instances(state, types, order_col), "instances")
    nodes = materialize(dedupe_nodes(tf_nodes(rows, "place"), "place").drop("place"), "nodes")
    parts = [tf_reference_edges(rows), tf_depends_on_edges(rows, resolve_modules), tf_association_edges(rows)]
    edges = reduce(DataFrame.unionByName, [df.withColumn("_o", F.struct(F.lit(i), "id")) for i, df in enumerate(parts)])
    kept, dropped = drop_dangling(nodes, dedupe_edges(edges, "_o").drop("_o"))
    return nodes, kept, dropped
