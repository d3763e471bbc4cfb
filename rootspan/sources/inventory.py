"""Cloud inventory rows → nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.functions.classify import lookup
from rootspan.operators.graph import dedupe_edges, dedupe_nodes, drop_dangling
from rootspan.scratch import materialize
from rootspan.sources.positions import positioned

# Class of a resource type.
TYPE_CLASSES = {
    "microsoft.compute/virtualmachines": "VirtualMachine", "microsoft.compute/virtualmachinescalesets": "VirtualMachineScaleSet", "microsoft.compute/disks": "Disk", "microsoft.compute/availabilitysets": "AvailabilitySet",
    "microsoft.compute/images": "Image", "microsoft.compute/snapshots": "Snapshot", "microsoft.containerservice/managedclusters": "AKSCluster", "microsoft.containerregistry/registries": "ContainerRegistry",
    "microsoft.containerinstance/containergroups": "ContainerGroup", "microsoft.app/containerapps": "ContainerApp", "microsoft.app/managedenvironments": "ContainerAppEnvironment", "microsoft.network/virtualnetworks": "VirtualNetwork",
    "microsoft.network/networkinterfaces": "NetworkInterface", "microsoft.network/networksecuritygroups": "NetworkSecurityGroup", "microsoft.network/publicipaddresses": "PublicIP", "microsoft.network/loadbalancers": "LoadBalancer",
    "microsoft.network/applicationgateways": "Gateway", "microsoft.network/frontdoors": "FrontDoor", "microsoft.network/privatednszones": "PrivateDNS", "microsoft.network/dnszones": "DNS",
    "microsoft.network/routetables": "RouteTable", "microsoft.network/privateendpoints": "PrivateEndpoint", "microsoft.network/bastionhosts": "BastionHost", "microsoft.network/azurefirewalls": "Firewall",
    "microsoft.network/connections": "VPNConnection", "microsoft.network/virtualnetworkgateways": "VNetGateway", "microsoft.network/localnetworkgateways": "LocalNetGateway", "microsoft.network/natgateways": "NATGateway",
    "microsoft.managedidentity/userassignedidentities": "ManagedIdentity", "microsoft.aad/domainservices": "AADDomainService", "microsoft.keyvault/vaults": "KeyVault", "microsoft.keyvault/managedhsms": "ManagedHSM",
    "microsoft.sql/servers": "SqlServer", "microsoft.sql/servers/databases": "SqlDatabase", "microsoft.sql/servers/elasticpools": "SqlElasticPool", "microsoft.dbformysql/flexibleservers": "MySqlServer",
    "microsoft.dbforpostgresql/flexibleservers": "PostgresServer", "microsoft.documentdb/databaseaccounts": "CosmosDB", "microsoft.cache/redis": "RedisCache", "microsoft.cache/redisenterprise": "RedisEnterprise",
    "microsoft.storage/storageaccounts": "StorageAccount", "microsoft.netapp/netappaccounts": "NetAppAccount", "microsoft.netapp/netappaccounts/capacitypools/volumes": "NetAppVolume", "microsoft.eventhub/namespaces": "EventHub",
    "microsoft.servicebus/namespaces": "ServiceBus", "microsoft.eventgrid/topics": "EventGridTopic", "microsoft.eventgrid/systemtopics": "EventGridSystemTopic", "microsoft.signalrservice/signalr": "SignalR",
    "microsoft.web/serverfarms": "AppServicePlan", "microsoft.web/sites": "AppService", "microsoft.web/staticsites": "StaticWebApp", "microsoft.cdn/profiles": "FrontDoorCDN",
    "microsoft.apimanagement/service": "APIManagement", "microsoft.insights/components": "AppInsights", "microsoft.operationalinsights/workspaces": "LogAnalytics", "microsoft.insights/actiongroups": "ActionGroup",
    "microsoft.insights/metricalerts": "MetricAlert", "microsoft.insights/scheduledqueryrules": "AlertRule", "microsoft.insights/datacollectionrules": "DCR", "microsoft.network/firewallpolicies": "FirewallPolicy",
    "microsoft.recoveryservices/vaults": "RecoveryVault", "microsoft.dataprotection/backupvaults": "BackupVault", "microsoft.logic/workflows": "LogicApp", "microsoft.automation/automationaccounts": "AutomationAccount",
    "microsoft.datafactory/factories": "DataFactory", "microsoft.machinelearningservices/workspaces": "MLWorkspace", "microsoft.search/searchservices": "CognitiveSearch", "microsoft.cognitiveservices/accounts": "CognitiveService",
}
_REF = "struct<id:string>"
_IPCONF = f"struct<properties:struct<subnet:{_REF},publicIPAddress:{_REF}>>"
_LINK = "struct<properties:struct<privateLinkServiceId:string>>"
PROPERTIES = (
    f"networkProfile struct<networkInterfaces:array<{_REF}>>, storageProfile struct<osDisk:struct<managedDisk:{_REF}>,dataDisks:array<struct<managedDisk:{_REF}>>>, availabilitySet {_REF}, "
    f"networkSecurityGroup {_REF}, ipConfigurations array<{_IPCONF}>, subnets array<struct<id:string,name:string,properties:struct<networkSecurityGroup:{_REF},routeTable:{_REF},natGateway:{_REF}>>>, "
    f"agentPoolProfiles array<struct<vnetSubnetID:string>>, frontendIPConfigurations array<{_IPCONF}>, backendAddressPools array<struct<properties:struct<backendIPConfigurations:array<{_REF}>>>>, "
    f"gatewayIPConfigurations array<{_IPCONF}>, subnet {_REF}, privateLinkServiceConnections array<{_LINK}>, manualPrivateLinkServiceConnections array<{_LINK}>"
)
#: Shape of inventory rows, JSON or nested.
RESOURCES = f"id string, name string, type string, location string, resourceGroup string, subscriptionId string, properties struct<{PROPERTIES.replace(' struct', ':struct').replace(' array', ':array').replace(', ', ',')}>, identity struct<userAssignedIdentities:map<string,struct<principalId:string>>>"


def arm_id(c: Column) -> Column:
    """Lower case without slashes at the end; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(c), "/+$", ""), F.lit(""))


def make_node(id: Column, label: Column, cls: Column, region: Column, properties: Column) -> list[Column]:
    return [id.alias("id"), label.alias("label"), cls.alias("class"), region.alias("region"), F.lit(None).cast("string").alias("rack_id"), properties.cast("map<string,string>").alias("properties")]


def make_edge(source: Column, target: Column, edge_type: str | Column = "dependency") -> list[Column]:
    kind = edge_type if isinstance(edge_type, Column) else F.lit(edge_type)
    name = F.concat(F.lit("edge-"), F.right(source, F.lit(60)), F.lit("-"), F.right(target, F.lit(60)))
    return [name.alias("id"), source.alias("source_id"), target.alias("target_id"), kind.alias("edge_type"), F.create_map().cast("map<string,string>").alias("properties")]


def _edges(df: DataFrame, source: Column, target: Column, edge_type: str) -> DataFrame:
    """Edges of the rows where both ends are given."""
    return df.select(*make_edge(source, target, edge_type)).where("source_id <> '' and target_id <> ''")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _of(resources: DataFrame, kind: str) -> DataFrame:
    return resources.where(F.lower("type") == kind).withColumn("own", arm_id(F.col("id")))


def filter_resources(resources: DataFrame, groups: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Rows of the resource groups and types, in any case; None for all."""
    out = resources
    for column, wanted in (("resourceGroup", groups), ("type", types)):
        if wanted:
            out = out.where(F.lower(column).isin([w.lower() for w in wanted]))
    return out


def _resource_properties() -> Column:
    return F.create_map(F.lit("resource_group"), F.coalesce("resourceGroup", F.lit("")), F.lit("subscription_id"), F.coalesce("subscriptionId", F.lit("")))


def resource_nodes(resources: DataFrame, *keep: Column) -> DataFrame:
    """A node for each resource, with further columns ``keep``; a type off the list is named by its last part."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    cls = lookup(kind, TYPE_CLASSES, F.initcap(F.element_at(F.split(kind, "/"), -1)))
    return resources.select(*make_node(arm_id(F.col("id")), F.coalesce("name", F.lit("")), cls, F.coalesce("location", F.lit("")), _resource_properties()), *keep)


def vm_edges(resources: DataFrame) -> DataFrame:
    vm, p = _of(resources, "microsoft.compute/virtualmachines"), "properties."
    nic = vm.select("own", F.explode(p + "networkProfile.networkInterfaces.id").alias("ref"))
    data = vm.select("own", F.explode(p + "storageProfile.dataDisks.managedDisk.id").alias("ref"))
    system = vm.select("own", F.col(p + "storageProfile.osDisk.managedDisk.id").alias("ref"))
    dependency = _union(nic, system, data)
    return _union(_edges(dependency, F.col("own"), arm_id(F.col("ref")), "dependency"), _edges(vm, arm_id(F.col(p + "availabilitySet.id")), F.col("own"), "containment"))


def nic_edges(resources: DataFrame) -> DataFrame:
    nic = _of(resources, "microsoft.network/networkinterfaces")
    conf = nic.select("own", F.explode("properties.ipConfigurations.properties").alias("c"))
    return _union(
        _edges(nic, arm_id(F.col("properties.networkSecurityGroup.id")), F.col("own"), "dependency"), _edges(conf, arm_id(F.col("c.subnet.id")), F.col("own"), "containment"), _edges(conf, F.col("own"), arm_id(F.col("c.publicIPAddress.id")), "dependency")
    )


def subnet_nodes_edges(resources: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Subnets inside virtual networks as nodes, with what they hang on.

    order: columns that tell the order of ``resources``; the nodes then have it in ``_o``.
    """
    inside = _of(resources, "microsoft.network/virtualnetworks").select("own", "location", "resourceGroup", "subscriptionId", *order, F.posexplode("properties.subnets").alias("at", "s"))
    inside = inside.withColumn("sub", arm_id(F.col("s.id"))).where("sub <> ''")
    place = [F.struct(*order, "at").alias("_o")] if order else []
    nodes = inside.select(*make_node(F.col("sub"), F.coalesce("s.name", F.lit("")), F.lit("Subnet"), F.coalesce("location", F.lit("")), _resource_properties()), *place)
    refs = [_edges(inside, arm_id(F.col(f"s.properties.{name}.id")), F.col("sub"), "dependency") for name in ("networkSecurityGroup", "routeTable", "natGateway")]
    return nodes, _union(_edges(inside, F.col("own"), F.col("sub"), "containment"), *refs)


def aks_edges(resources: DataFrame) -> DataFrame:
    aks = _of(resources, "microsoft.containerservice/managedclusters")
    pools = aks.select("own", F.explode("properties.agentPoolProfiles.vnetSubnetID").alias("ref"))
    identities = aks.select("own", F.explode(F.map_keys("identity.userAssignedIdentities")).alias("ref"))
    return _union(_edges(pools, arm_id(F.col("ref")), F.col("own"), "containment"), _edges(identities, arm_id(F.col("ref")), F.col("own"), "dependency"))


def lb_edges(resources: DataFrame) -> DataFrame:
    lb = _of(resources, "microsoft.network/loadbalancers")
    front = lb.select("own", F.explode("properties.frontendIPConfigurations.properties").alias("c"))
    back = lb.select("own", F.explode(F.flatten(F.filter("properties.backendAddressPools.properties.backendIPConfigurations", lambda x: x.isNotNull()))).alias("c"))
    return _union(
        _edges(front, arm_id(F.col("c.subnet.id")), F.col("own"), "containment"), _edges(front, F.col("own"), arm_id(F.col("c.publicIPAddress.id")), "dependency"),
        _edges(back, F.col("own"), F.substring_index(arm_id(F.col("c.id")), "/ipconfigurations/", 1), "dependency"),
    )


def appgw_edges(resources: DataFrame) -> DataFrame:
    conf = _of(resources, "microsoft.network/applicationgateways").select("own", F.explode("properties.gatewayIPConfigurations.properties").alias("c"))
    return _edges(conf, arm_id(F.col("c.subnet.id")), F.col("own"), "containment")


def private_endpoint_edges(resources: DataFrame) -> DataFrame:
    pe, none = _of(resources, "microsoft.network/privateendpoints"), F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(F.col(f"properties.{n}.properties.privateLinkServiceId"), none) for n in ("privateLinkServiceConnections", "manualPrivateLinkServiceConnections")])
    links = pe.select("own", F.explode(both).alias("ref"))
    return _union(_edges(pe, arm_id(F.col("properties.subnet.id")), F.col("own"), "containment"), _edges(links, F.col("own"), arm_id(F.col("ref")), "dependency"))


def sql_edges(resources: DataFrame) -> DataFrame:
    """Server → database; the server is what stands before the last ``/databases/``."""
    db = _of(resources, "microsoft.sql/servers/databases")
    return _edges(db, F.regexp_extract("own", "^(.*)/databases/", 1), F.col("own"), "containment")


def resource_group_nodes_edges(resources: DataFrame, order_col: str) -> tuple[DataFrame, DataFrame]:
    """A node for each subscription and group, at the place of its first resource by ``order_col``."""
    rows = resources.where("coalesce(resourceGroup, '') <> '' and coalesce(subscriptionId, '') <> ''")
    rows = rows.withColumn("own", arm_id(F.col("id"))).withColumn("rg", arm_id(F.concat(F.lit("/subscriptions/"), "subscriptionId", F.lit("/resourcegroups/"), "resourceGroup")))
    first = rows.groupBy("rg").agg(F.min_by(F.struct("location", "resourceGroup", "subscriptionId"), order_col).alias("f")).select("rg", "f.*")
    nodes = first.select(*make_node(F.col("rg"), F.col("resourceGroup"), F.lit("ResourceGroup"), F.coalesce("location", F.lit("")), _resource_properties()))
    return nodes, _edges(rows, F.col("rg"), F.col("own"), "containment")


def build_graph(resources: DataFrame, order_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, dangling)`` of all extractors; the last node of an id, in the order of resources, subnets and groups and inside these of the rows, and the first edge of a key win.

    The order of rows is that of ``order_col``, else their place in the input (``input_position``).
    """
    rows = materialize(positioned(resources, "pos", order_col), "resources")
    subnets, subnet_edges = subnet_nodes_edges(rows, "pos")
    groups, group_edges = resource_group_nodes_edges(rows, "pos")
    parts = [vm_edges(rows), nic_edges(rows), subnet_edges, aks_edges(rows), lb_edges(rows), appgw_edges(rows), private_endpoint_edges(rows), sql_edges(rows), group_edges]
    place = lambda part, pos, at: F.struct(F.lit(part).alias("part"), pos.alias("pos"), at.cast("int").alias("at")).alias("_o")
    own = resource_nodes(rows, place(0, F.col("pos"), F.lit(0)))
    nowhere = F.lit(None).cast(rows.schema["pos"].dataType)
    nodes = _union(own, subnets.withColumn("_o", place(1, F.col("_o.pos"), F.col("_o.at"))), groups.withColumn("_o", place(2, nowhere, F.lit(0))))
    edges = _union(*[df.withColumn("_o", F.struct(F.lit(i), F.coalesce("id", F.lit("")))) for i, df in enumerate(parts)])
    nodes = materialize(dedupe_nodes(nodes, "_o").drop("_o"), "nodes")
    kept, dropped = drop_dangling(nodes, dedupe_edges(edges, "_o").drop("_o"))
    return nodes, kept, dropped


